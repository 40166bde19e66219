from tonescale.functions.scalars import (
    DIMENSION_NAMES,
    DIMENSIONS,
    MISSING_TOKENS,
    SCALE,
    dimension_name,
    fixed4,
    is_present,
    is_scaled,
    missing_to_null,
    number_after_equals,
    rest_after_equals,
    scale_target,
    smooth_l1,
    to_number,
    tokens,
    unscale_prediction,
)

__all__ = [
    "DIMENSION_NAMES",
    "DIMENSIONS",
    "MISSING_TOKENS",
    "SCALE",
    "dimension_name",
    "fixed4",
    "is_present",
    "is_scaled",
    "missing_to_null",
    "number_after_equals",
    "rest_after_equals",
    "scale_target",
    "smooth_l1",
    "to_number",
    "tokens",
    "unscale_prediction",
]
