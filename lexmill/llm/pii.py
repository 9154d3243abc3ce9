"""Personal data: base spans by pattern, and terms that the corpus shows to disclose a protected entity.

Everything is DataFrame and SQL functions. The quantifiers of the patterns are possessive wherever that
changes no match, so that Java's matcher neither recurses nor runs over a long run of characters again
and again.

A term discloses an entity (a protected value such as one e-mail address) if its occurrence tells most of
what the entity's own occurrence would: with the information content IC(e) = log2(N / df(e)) and the
pointwise mutual information PMI(t; e) = log2(N * df(t, e) / (df(t) * df(e))) over the documents of the
corpus, PMI(t; e) / IC(e) is 1 if the term is never met without the entity, and 0 if they are
independent. Terms are words of whole documents, base spans being separators, and co-occurrence is counted
by documents. A word is considered for an entity if it is met with it in several different surroundings, so
that its evidence doesn't come from copies of one text, or if it stands near a mention and is so rare that
PMI alone is strong evidence (it makes the entity 2**least_bits times as likely as chance). What discloses
an entity is marked wherever it stands in the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.storage import written

#: Java patterns by kind, in the order of the digest.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text holds if it holds a match: far cheaper to look for.
_HINTS = {"email": "contains(t, '@')", "ip": r"rlike(t, r'[0-9]\.[0-9]')", "card": r"rlike(t, r'[0-9][\x20-9-]{14,}[0-9]')", "phone": "contains(t, '+')"}
_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + element_at(
    if(i % 2 = 1, array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9), array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)), 1 + int(substring(reverse({_DIGITS}), i, 1)))) % 10 = 0"""
#: Which matches count; the others are dropped.
_VALID = {
    "email": "true",
    "ip": r"forall(split(x.v, '[.]'), p -> length(trim(leading '0' from p)) <= 3 and int(concat('0', right(p, 4))) <= 255)",
    "card": f"length({_DIGITS}) between 16 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 8 and 15",
}
_EDGES = ".,;:!?()[]{}<>\"'`*_|/\\+=~#@&%$^-"
#: What a span protects, however it is written.
_ENTITY = "concat(x.kind, ':', case when x.kind in ('card', 'phone') then regexp_replace(x.v, '[^0-9]', '') else lower(x.v) end)"
SPAN = "array<struct<kind:string,s:int,e:int,v:string>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _placed(found: str, gaps: str) -> str:
    """Matches with their starts and ends, from them and the pieces of text between them."""
    return f"""aggregate(sequence(0, size({found}) - 1),
        named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,v:string>>)),
        (a, i) -> named_struct('at', a.at + length({gaps}[i]) + length({found}[i]),
            'out', array_append(a.out, named_struct('s', a.at + length({gaps}[i]), 'e', a.at + length({gaps}[i]) + length({found}[i]), 'v', {found}[i]))),
        a -> a.out)"""


def with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """docs with `t`, the text or '', and `spans`, the base spans by kind, then start (offsets in code points)."""
    rows = docs.withColumn("t", F.coalesce(text, F.lit("")))
    for kind, pattern in KINDS.items():
        rows = rows.withColumn(f"_{kind}", F.expr(f"case when {_HINTS[kind]} then regexp_extract_all(t, {_quoted(pattern)}, 0) else cast(array() as array<string>) end"))
    for kind, pattern in KINDS.items():
        rows = rows.withColumn(f"_{kind}_gaps", F.expr(f"case when size(_{kind}) > 0 then split(t, {_quoted(pattern)}, -1) end"))
    parts = [f"""case when size(_{kind}) > 0 then transform(filter({_placed(f'_{kind}', f'_{kind}_gaps')}, x -> {_VALID[kind]}),
        x -> named_struct('kind', '{kind}', 's', x.s, 'e', x.e, 'v', x.v)) else cast(array() as {SPAN}) end""" for kind in KINDS]  # fmt: skip
    return rows.withColumn("spans", F.expr(f"concat({', '.join(parts)})")).drop(*[f"_{k}{x}" for k in KINDS for x in ("", "_gaps")])


def _row_key(id_col: str) -> Column:
    """Stands for a row by what it holds: rows of equal id and text have equal spans."""
    return F.struct(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col("t")).alias("a"), F.length("t").alias("b"))


_CUT = """case when size(spans) = 0 then t else aggregate(array_sort(transform(spans, x -> struct(x.s as s, x.e as e))), named_struct('at', 0, 'out', ''), (a, x) ->
    if(x.e <= a.at, a, named_struct('at', x.e, 'out', concat(a.out, substring(t, a.at + 1, greatest(0, x.s - a.at)), repeat(' ', x.e - greatest(x.s, a.at))))),
    a -> concat(a.out, substring(t, a.at + 1))) end"""
_WORD = _quoted(r"[^\x20\x09-\x0D]+")


def cut_at_spans(spanned: DataFrame) -> DataFrame:
    """spanned with `cut`: t with blanks for base spans, so that words end there and offsets hold."""
    return spanned.withColumn("cut", F.expr(_CUT))


def mentions(spanned: DataFrame, around: int) -> DataFrame:
    """(row, entity, surroundings, words) for each base span: whole words within `around` code points, and the hash of what is there."""
    m = cut_at_spans(spanned.where("size(spans) > 0")).select("row", "t", "cut", F.explode("spans").alias("x"))
    m = m.withColumn("entity", F.expr(_ENTITY))
    m = m.withColumn("left_at", F.greatest(F.lit(0), F.col("x.s") - around)).withColumn("right_at", F.col("x.e"))
    sides = []
    for text in ("t", "cut"):
        m = m.withColumn(f"{text}_left", F.expr(f"substring({text}, left_at + 1, x.s - left_at)")).withColumn(f"{text}_right", F.expr(f"substring({text}, right_at + 1, {around})"))
        # words that the window cuts are left out: blanked, so that offsets hold
        m = m.withColumn(f"{text}_left", F.expr(rf"case when left_at > 0 then concat(repeat(' ', length(regexp_extract({text}_left, r'^[^\x20\x09-\x0D]+', 0))), regexp_replace({text}_left, r'^[^\x20\x09-\x0D]+', '')) else {text}_left end"))
        m = m.withColumn(f"{text}_right", F.expr(rf"case when length(t) > right_at + {around} then regexp_replace({text}_right, r'[^\x20\x09-\x0D]+$', '') else {text}_right end"))
        sides += [f"{text}_left", f"{text}_right"]
    return m.select("row", "entity", F.xxhash64(*sides[:2]).alias("surroundings"), terms_of(F.concat_ws(" ", *sides[2:])).alias("words"))


def terms_of(text: Column) -> Column:
    """The distinct words of a text, without edges and in lower case."""
    words = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")
    return F.array_distinct(F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(_EDGES)))))


def term_of(column: str) -> Column:
    return F.expr(f"lower(trim(both {_quoted(_EDGES)} from {column}))")


#: Bits of a filter of keys, in buckets of 512 longs: 8 MB, however many keys there are.
FILTER_BITS, _BUCKET_BITS = 1 << 26, 512 * 64


def key_filter(hashes: DataFrame) -> DataFrame:
    """(bucket, bits) of a Bloom filter of the hashes (h): at most FILTER_BITS / 8 bytes. Beyond some ten million keys it lets most through."""
    place = F.pmod("h", F.lit(FILTER_BITS))
    longs = hashes.select(place.alias("p")).groupBy(F.expr("p div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, int(p % 64)))").alias("m"))
    found = longs.groupBy(F.expr("i div 512").alias("bucket")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("int(i % 512)"), "m"))).alias("by"))
    return found.select("bucket", F.expr("transform(sequence(0, 511), k -> coalesce(by[k], 0L))").alias("bits"))


def likely(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """All rows whose values in the columns of keys are among keys, and few others: by a filter of fixed size."""
    by = F.xxhash64(*keys.columns)
    held = F.broadcast(key_filter(keys.select(by.alias("h"))))
    placed = rows.withColumn("p", F.pmod(by, F.lit(FILTER_BITS)))
    return placed.join(held, F.col("bucket") == F.expr(f"p div {_BUCKET_BITS}")).where("shiftright(bits[int(p div 64 % 512)], int(p % 64)) & 1 = 1").select(*rows.columns)


def occurrences(docs: DataFrame, terms: DataFrame, common: DataFrame) -> DataFrame:
    """(row, term) for each document (row, t) and each of terms (distinct) that it holds.

    Words that aren't terms are left out before anything is shuffled: nearly all by a filter of fixed size, and those of
    common, of bounded number and length, whatever the filter says, so that no word of every document becomes a hot key.
    """
    words = docs.select("row", F.explode(terms_of(F.col("t"))).alias("term")).where("term <> ''")
    return likely(words, terms).join(F.broadcast(common), "term", "left_anti").join(terms.hint("merge"), "term").distinct()


#: Words that occur in most documents with base spans are told apart early: so many, of at most so many letters.
COMMON_WORDS, COMMON_LENGTH = 10_000, 64


def disclosing(base: DataFrame, around: int, least_surroundings: int, least_bits: float, generalise_at: float, remove_at: float) -> tuple[DataFrame, DataFrame]:
    """(entity, term, disclosure, action): the terms whose PMI with an entity is at least generalise_at of its information content.

    Also (row, term) of the documents that hold a considered term. base has the rows of all documents (row, t, spans).
    Rows of equal id and text count once. A term is in at least as many documents as it is in those with base
    spans: where that alone rules it out, as for all common words, the corpus isn't asked for it.
    """
    found = written(mentions(base, around), "pii-mentions")
    total = F.lit(float(base.select("row").distinct().count()))
    pmi = lambda joint, df: F.log2(total * F.col(joint) / F.col(df) / F.col("entity_df"))
    much = lambda joint, df: pmi(joint, df) >= generalise_at * F.col("ic")
    telling = lambda joint, df: much(joint, df) & (F.col("repeated") | (pmi(joint, df) >= least_bits))
    per_row = written(found.groupBy("row", "entity").agg(F.xxhash64(F.sort_array(F.collect_set("surroundings"))).alias("kind")), "pii-entities")
    often = found.groupBy("entity").agg((F.countDistinct("surroundings") >= least_surroundings).alias("often"))
    entities = per_row.groupBy("entity").agg(F.count("*").alias("entity_df")).join(often, "entity")
    entities = written(entities.withColumn("ic", F.log2(total / F.col("entity_df"))).where("ic > 0"), "pii-entity-counts")
    # a document's words stay together, beside its entities, until the pairs that can't count are ruled out
    of_row = per_row.join(entities, "entity").groupBy("row").agg(F.collect_list(F.struct("entity", "kind", "entity_df", "often", "ic")).alias("entities"))
    texts = cut_at_spans(base.where("size(spans) > 0").select("row", "t", "spans").dropDuplicates(["row"]))
    texts = written(texts.select("row", F.array_remove(terms_of(F.col("cut")), "").alias("terms")).join(of_row, "row", "left"), "pii-terms")
    at_least = written(texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("least_df")), "pii-least")
    short = at_least.where(F.length("term") <= COMMON_LENGTH)
    frequent = written(short.orderBy(F.desc("least_df"), "term").limit(COMMON_WORDS).withColumnRenamed("least_df", "frequent_df"), "pii-frequent")
    near = found.select("entity", "surroundings", F.explode("words").alias("term")).where("term <> ''").groupBy("entity", "term").agg((F.countDistinct("surroundings") >= least_surroundings).alias("repeated"))
    near = near.join(entities, "entity").join(at_least, "term").withColumn("at_most", F.least("entity_df", "least_df"))
    near = written(near.where(telling("at_most", "least_df")).select("entity", "term", "repeated", "often"), "pii-near")

    def pairs(of: DataFrame) -> DataFrame:
        """The words of an entity's documents, but for frequent ones that can't tell enough of it."""
        all_of = of.select("entity", "kind", "entity_df", "often", "ic", F.explode("terms").alias("term"))
        bounded = all_of.join(F.broadcast(frequent), "term", "left").withColumn("at_most", F.least("entity_df", "frequent_df"))
        return bounded.where(F.col("frequent_df").isNull() | much("at_most", "frequent_df")).drop("at_most", "frequent_df")

    each = texts.select("terms", F.explode("entities").alias("x")).select("terms", "x.*")
    considered = pairs(each.where("often")).unionByName(likely(pairs(each.where("not often")), near.where("not often").select("entity", "term")))
    joint = considered.groupBy("entity", "term").agg(*[F.first(c).alias(c) for c in ("entity_df", "often", "ic")], F.count("*").alias("joint"), F.countDistinct("kind").alias("kinds"))
    joint = joint.join(near.drop("often"), ["entity", "term"], "left").withColumn("repeats", F.col("often") & (F.col("kinds") >= least_surroundings))
    joint = joint.where("repeats or repeated is not null").withColumn("repeated", F.expr("repeats or coalesce(repeated, false)"))
    possible = joint.join(at_least, "term").where(telling("joint", "least_df"))
    possible = written(possible.select("entity", "term", "repeated", "entity_df", "ic", "joint"), "pii-joint")
    terms = possible.select("term").distinct()
    common = short.join(terms, "term", "left_anti").orderBy(F.desc("least_df"), "term").limit(COMMON_WORDS).select("term")
    held = written(occurrences(cut_at_spans(base).select("row", F.col("cut").alias("t")), terms, written(common, "pii-common")), "pii-held")
    scored = possible.join(held.groupBy("term").agg(F.count("*").alias("df")), "term").where(telling("joint", "df")).withColumn("disclosure", pmi("joint", "df") / F.col("ic"))
    return scored.select("entity", "term", "disclosure", F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise").alias("action")), held


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is computed once: the optimiser would put it into every turn of body's loops."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Where the words p.w, with the pieces p.g between them, are among the keys of p.chosen.
_OCCURRENCES = f"""aggregate(sequence(0, size(p.w) - 1), named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,action:string>>)),
    (a, i) -> named_struct('at', a.at + length(p.g[i]) + length(p.w[i]), 'out',
        case when element_at(p.chosen, lower(trim(both {_quoted(_EDGES)} from p.w[i]))) is null then a.out
             else array_append(a.out, named_struct('s', a.at + length(p.g[i]) + length(p.w[i]) - length(trim(leading {_quoted(_EDGES)} from p.w[i])),
                 'e', a.at + length(p.g[i]) + length(p.w[i]) - length(trim(leading {_quoted(_EDGES)} from p.w[i])) + length(trim(both {_quoted(_EDGES)} from p.w[i])),
                 'action', element_at(p.chosen, lower(trim(both {_quoted(_EDGES)} from p.w[i]))))) end),
    a -> a.out)"""


def with_terms(base: DataFrame, around: int = 80, least_surroundings: int = 3, least_bits: float = 7.0, generalise_at: float = 0.95, remove_at: float = 0.99) -> DataFrame:
    """base (row, t, spans and more, all documents) with `terms`: spans (s, e, action) of every occurrence of a disclosing term."""
    terms, held = disclosing(base, around, least_surroundings, least_bits, generalise_at, remove_at)
    terms = terms.groupBy("term").agg(F.max("action").alias("action"))
    met = written(held.join(terms, "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("chosen")), "pii-met")
    none = "cast(array() as array<struct<s:int,e:int,action:string>>)"
    parts = f"named_struct('w', regexp_extract_all(cut, {_WORD}, 0), 'g', split(cut, {_WORD}, -1), 'chosen', chosen)"
    out = cut_at_spans(base.join(met, "row", "left"))
    return out.withColumn("terms", F.expr(f"case when chosen is null then {none} else {_let('p', parts, _OCCURRENCES)} end")).drop("cut", "chosen")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", around: int = 80, least_surroundings: int = 3, least_bits: float = 7.0, generalise_at: float = 0.95, remove_at: float = 0.99) -> DataFrame:
    """Per row of docs: n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, comma-joined).

    Spans are in code points, end exclusive, by kind (email, ip, card, phone, then term), then start; the
    digest is of the base ones. Null text counts as empty; a null id stays null; repeated rows give
    repeated results; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    spanned = with_spans(rows, F.col("t")).withColumn("row", _row_key("doc_id"))
    base = written(spanned.select("doc_id", "row", "spans", "t"), "pii-base")
    out = with_terms(base, around, least_surroundings, least_bits, generalise_at, remove_at)
    joined = F.expr("array_join(transform(spans, x -> concat_ws(':', x.kind, x.s, x.e)), ',')")
    all_spans = F.expr("array_join(concat(transform(spans, x -> concat_ws(':', x.kind, x.s, x.e)), transform(terms, x -> concat_ws(':', 'term', x.s, x.e))), ',')")
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined, 256).alias("base_sha256"), all_spans.alias("spans"))


_MERGED = """aggregate(m, cast(array() as array<struct<s:int,e:int,label:string>>), (a, x) ->
    case when size(a) > 0 and x.s < element_at(a, -1).e
         then concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e), 'label', element_at(a, -1).label)))
         else array_append(a, x) end)"""
_REBUILT = """concat(array_join(transform(c, (x, i) -> concat(
    substring(t, 1 + if(i = 0, 0, c[i - 1].e), x.s - if(i = 0, 0, c[i - 1].e)), x.label)), ''), substring(t, 1 + element_at(c, -1).e))"""
_CUTS = """array_sort(concat(
    transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'label', concat('[', upper(x.kind), ']'))),
    transform(terms, x -> named_struct('s', x.s, 'e', x.e, 'label', case when x.action = 'remove' then '' when rlike(substring(t, x.s + 1, x.e - x.s), '[0-9]') then '[NUMBER]' else '[TERM]' end))))"""


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", around: int = 80, least_surroundings: int = 3, least_bits: float = 7.0, generalise_at: float = 0.95, remove_at: float = 0.99) -> DataFrame:
    """docs with the text column rewritten: base spans give way to [EMAIL], [IP], [CARD] or [PHONE], disclosing terms go or are generalised.

    A generalised term becomes [NUMBER] if it has a digit, else [TERM]. Spans that overlap are cut out as one. Texts
    without spans stay as they are, null included; all other columns come along.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"))  # so that no column clashes with one of ours
    rows = with_spans(packed, F.col(f"_all.`{text_col}`")).withColumn("row", F.struct(F.xxhash64(F.col(f"_all.`{id_col}`").cast("string"), F.col("t")).alias("a"), F.length("t").alias("b")))
    base = written(rows.select("_all", "row", "spans", "t"), "pii-base")
    out = with_terms(base, around, least_surroundings, least_bits, generalise_at, remove_at)
    changed = _let("m", _CUTS, _let("c", _MERGED, _REBUILT))
    new = F.expr(f"case when size(spans) + size(terms) > 0 then {changed} else _all.`{text_col}` end")
    return out.select(*[new.alias(c) if c == text_col else F.col(f"_all.`{c}`").alias(c) for c in columns])
