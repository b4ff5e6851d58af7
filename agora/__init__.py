"""agora — marketplace analytics as bulk PySpark jobs.

Every operator takes a :class:`agora.sources.tables.Tables` bundle (eight
marketplace DataFrames) plus explicit parameters (``as_of``,
``demo_domain``, ``real_only``) and returns a lazy DataFrame. Nothing is
collected inside an operator.
"""

from agora.config import AS_OF, DEMO_DOMAIN, build_session

__all__ = ["AS_OF", "DEMO_DOMAIN", "build_session"]
