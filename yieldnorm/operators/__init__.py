from . import enrich, fact, geo, model, quality, rank, stats, trees, weather, yields

__all__ = ["enrich", "fact", "geo", "model", "quality", "rank", "stats", "weather", "yields"]
