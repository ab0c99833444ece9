"""The closed set of workflow settings."""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType

#: Setting -> default.
DEFAULTS = MappingProxyType(
    {
        "as_of_year": None,
        "apply_time_filter": True,
        "min_papers": 5,
        "top_n": 10,
        "max_institutions_per_paper": 50,
        "topic_candidates": (3, 4, 5, 6, 7, 8, 9, 10),
        "topics": True,
        "topic_scopes": ("Global_All",),
        "nmf_iterations": 500,
        "country": None,
        "topic_bin_years": 5,
        "topic_cooccurrence": 0.1,
        "min_country_documents": 10,
        "min_df": None,
        "max_df": 0.90,
        "search_query": "",
        "drop_unknown_countries": True,
        "seed": 42,
        "progress": None,
    }
)


def resolve_config(given: Mapping | None = None) -> dict:
    """The defaults with ``given`` laid over them; an unknown setting is an error."""
    given = dict(given or {})
    if unknown := sorted(set(given) - set(DEFAULTS)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return {**DEFAULTS, **given}
