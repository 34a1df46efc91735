"""quillspan: document, conversation and graph analytics as PySpark DataFrame operators."""
