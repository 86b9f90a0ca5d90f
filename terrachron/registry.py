"""Every registered query of the engine, with the SQL that must give the same rows."""

from __future__ import annotations

import terrachron.plans.bundles  # noqa: F401  registers its queries
import terrachron.plans.compiled  # noqa: F401  registers its queries
import terrachron.plans.matches  # noqa: F401  registers its queries
import terrachron.plans.proofs  # noqa: F401  registers its queries
import terrachron.plans.records  # noqa: F401  registers its queries
import terrachron.plans.surfaces  # noqa: F401  registers its queries
import terrachron.plans.territories  # noqa: F401  registers its queries
from terrachron.plans.queries import ORACLE_SQL, QUERIES, q01_as_of

FLAGSHIP = q01_as_of

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
