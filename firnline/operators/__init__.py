from firnline.operators.complete import complete_template, plot_template
from firnline.operators.coords import centroids, coord_export, coord_table
from firnline.operators.geo import utm_forward, utm_inverse, zone_number
from firnline.operators.joins import dimension_left_join, left_join, natural_left_join
from firnline.operators.multipart import merge_parts, resolve_multipart
from firnline.operators.reshape import to_long
from firnline.operators.rows import (
    align,
    append_row,
    bind_cols,
    cast_range,
    col_range,
    copy_rows,
    distinct_rows,
    drop_cols,
    fill_down,
    keep,
    literal_table,
    rename_select,
    slice_rows,
    sort_rows,
    starts_with,
    union_all,
    with_ordinal,
)
from firnline.operators.rules import apply_aliases, apply_corrections, default_value, override
from firnline.operators.station import (
    merge_station_cores,
    normalise_prefix,
    sensor_depth,
    station_observations,
)
from firnline.operators.summarise import average_repeats, summarise_plots
from firnline.operators.totals import (
    check_counts,
    daily_totals,
    grand_total,
    key_count,
    period_totals,
    rows_per_key,
)

__all__ = [
    "align",
    "append_row",
    "apply_aliases",
    "apply_corrections",
    "average_repeats",
    "bind_cols",
    "cast_range",
    "centroids",
    "check_counts",
    "col_range",
    "complete_template",
    "coord_export",
    "coord_table",
    "copy_rows",
    "daily_totals",
    "default_value",
    "dimension_left_join",
    "distinct_rows",
    "drop_cols",
    "fill_down",
    "grand_total",
    "keep",
    "key_count",
    "left_join",
    "literal_table",
    "merge_parts",
    "merge_station_cores",
    "natural_left_join",
    "normalise_prefix",
    "override",
    "period_totals",
    "plot_template",
    "rename_select",
    "resolve_multipart",
    "rows_per_key",
    "sensor_depth",
    "slice_rows",
    "sort_rows",
    "starts_with",
    "station_observations",
    "summarise_plots",
    "to_long",
    "union_all",
    "utm_forward",
    "utm_inverse",
    "with_ordinal",
    "zone_number",
]
