"""quillmark: transcript-quality analytics expressed as PySpark DataFrame plans."""
