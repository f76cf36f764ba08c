"""Operators for training-data pipelines over document tables (doc_id, text, ...). Nothing else in the library imports
this subpackage; its queries are listed in :mod:`skydelay.llm.queries`."""
