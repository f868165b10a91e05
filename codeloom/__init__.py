"""Code context for whole corpora of Go projects, as Spark jobs."""

from codeloom.plans.index import Index, extract
from codeloom.schemas import Facts
from codeloom.sources.corpus import load_modules, load_source_corpus, load_source_table

__all__ = ["Facts", "Index", "extract", "load_modules", "load_source_corpus", "load_source_table"]
