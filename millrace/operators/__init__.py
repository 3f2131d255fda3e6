from .relational import (
    cross,
    distinct,
    equi_keys,
    group_by,
    join,
    order_violations,
    project,
    row_count,
    select_pipe,
    sort,
    sort_all,
    sum_distinct_rows,
    sum_of,
    total,
)

__all__ = ["cross", "distinct", "equi_keys", "group_by", "join", "order_violations", "project", "row_count", "select_pipe", "sort", "sort_all", "sum_distinct_rows", "sum_of", "total"]
