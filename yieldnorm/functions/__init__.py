from .codes import first_key, fips5, norm_abbr, norm_county, pad_fips, strip_ws, zfill
from .geometry import bbox_of_ring, cell_of, ring_contains, two_d

__all__ = ["first_key", "fips5", "norm_abbr", "norm_county", "pad_fips", "strip_ws", "zfill",
           "bbox_of_ring", "cell_of", "ring_contains", "two_d"]
