"""DataFrame operators; each builds a declarative plan and leaves the physical choice to Spark."""

from .aggregate import aggregate, distinct_aggregate, global_aggregate  # noqa: F401
from .dml import Table, VersionedStore  # noqa: F401
from .filters import between, bloom_semi, in_list, is_null, not_in_list, where  # noqa: F401
from .joins import anti, block_join, cross, equi_join, left_join, multiway, null_aware_anti, semi, theta_join  # noqa: F401
from .projection import project, project_all, qualify  # noqa: F401
from .scans import constant, one_row, scan  # noqa: F401
from .sorting import distinct, order, page, top_k  # noqa: F401
