from . import flows, notebooks, sizing

__all__ = ["flows", "notebooks", "sizing"]
