from . import annual

__all__ = ["annual"]
