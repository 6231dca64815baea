"""Operations for large training-data pipelines; nothing else in meshwork imports this package."""
