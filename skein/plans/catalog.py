"""All queries of the core library and their SQL, collected from the plan modules."""

from __future__ import annotations

from skein.plans import chat, composite, corpus, retrieval, signals, streams, text  # noqa: F401  they register themselves
from skein.plans.registry import ORACLES, QUERIES  # noqa: F401
