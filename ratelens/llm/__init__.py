"""Operations of a training-data pipeline: one module per operator, the thin
registered queries in ``registry``.  Nothing outside this package imports it."""
