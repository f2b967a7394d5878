"""All registered queries."""

from __future__ import annotations

from zonetide.plans import by_source  # noqa: F401
from zonetide.plans import by_scalar  # noqa: F401
from zonetide.plans import by_join  # noqa: F401
from zonetide.plans import by_aggregate  # noqa: F401
from zonetide.plans import by_window  # noqa: F401
from zonetide.plans import by_panel  # noqa: F401
from zonetide.plans import by_space  # noqa: F401
from zonetide.plans import by_study  # noqa: F401
from zonetide.plans import by_forecast  # noqa: F401
from zonetide.plans import by_rule  # noqa: F401
from zonetide.plans import by_stream  # noqa: F401
from zonetide.plans import by_flow  # noqa: F401
from zonetide.plans.registry import REGISTRY, run

__all__ = ["REGISTRY", "run"]
