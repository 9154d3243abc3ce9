"""Operations of a training-data pipeline; nothing else in lexmill imports this package."""
