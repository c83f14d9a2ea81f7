"""Operations of a training-data pipeline over text and page tables. Nothing outside this package imports it."""
