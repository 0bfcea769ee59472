"""Column-expression helpers (built-in Spark functions only)."""

from costsieve.functions.categories import (  # noqa: F401
    has_text,
    is_block_storage,
    is_compute,
    is_snapshot,
    is_storage,
    service_category,
)
from costsieve.functions.numeric import (  # noqa: F401
    clamp,
    fmt_fixed,
    fmt_grouped,
    money,
    nan_to_null,
    np_round,
    py_round,
)
