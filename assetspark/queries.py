"""The registered queries of the engine and the SQL that each must equal."""

from assetspark.plans import binary, containers, decoding, relational, recommending, scalars, scanning, verifying  # noqa: F401
from assetspark.plans.registry import ORACLES, QUERIES  # noqa: F401
