from runweave.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
