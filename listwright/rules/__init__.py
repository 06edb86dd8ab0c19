"""Rule tables: the engine's policy as data."""

from listwright.rules.ruleset import RuleSet, load_rules
from listwright.rules.defaults import default_rules

__all__ = ["RuleSet", "default_rules", "load_rules"]
