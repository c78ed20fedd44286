"""Imports every module that registers driver queries."""

from limnos.plans import registry_basics  # noqa: F401
from limnos.plans import registry_impute  # noqa: F401
from limnos.plans import registry_models  # noqa: F401
from limnos.plans import registry_relational  # noqa: F401
