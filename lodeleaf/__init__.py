"""A PySpark-native, offline document-retrieval and analytics engine."""

from lodeleaf.config import Config
from lodeleaf.functions.embedding import HashingEmbedder, get_embedder
from lodeleaf.operators.answer import Answer, Citation
from lodeleaf.plans.engine import Engine
from lodeleaf.sources.audit_log import AuditLog
from lodeleaf.sources.store import Store

__all__ = ["Answer", "AuditLog", "Citation", "Config", "Engine", "HashingEmbedder", "Store", "get_embedder"]
__version__ = "0.1.0"
