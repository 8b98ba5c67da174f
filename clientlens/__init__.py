"""clientlens: access-log census on Spark, plus training-data operators in ``clientlens.llm``."""
