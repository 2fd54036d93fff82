"""Imports every catalog module so that its queries are registered."""

from flowsift.plans import catalog_core  # noqa: F401
from flowsift.plans import catalog_windows  # noqa: F401
from flowsift.plans import catalog_prep  # noqa: F401
from flowsift.plans import catalog_models  # noqa: F401
from flowsift.plans import catalog_streaming  # noqa: F401
from flowsift.plans import catalog_sources  # noqa: F401
