"""Operations of a training-data pipeline: one module per operator, each from DataFrame to DataFrame."""
