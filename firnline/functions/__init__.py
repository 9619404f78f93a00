from firnline.functions.missing import first_by, first_of, skip, strict, sum_or_zero
from firnline.functions.parse import (
    blank_to_null,
    core_key,
    day_of,
    decode_position,
    digits,
    format_time,
    paste,
    parse_number,
    parse_time,
    truncate,
)
from firnline.functions.snow import (
    PI,
    TUBE_RADIUS_CM,
    case_when,
    density,
    density_columns,
    density_or_zero,
    net_mass,
    scale_units,
    swe,
    typed_depth,
)

__all__ = [
    "PI",
    "TUBE_RADIUS_CM",
    "blank_to_null",
    "case_when",
    "core_key",
    "day_of",
    "decode_position",
    "density",
    "density_columns",
    "density_or_zero",
    "digits",
    "first_by",
    "first_of",
    "format_time",
    "net_mass",
    "parse_number",
    "parse_time",
    "paste",
    "scale_units",
    "skip",
    "strict",
    "sum_or_zero",
    "swe",
    "truncate",
    "typed_depth",
]
