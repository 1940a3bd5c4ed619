"""Operations of a training-data pipeline. Nothing outside this folder (but corpus_pipeline.py) imports it."""
