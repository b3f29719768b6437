from runweave.operators.chunks import (
    apportion,
    assign_chunks,
    chunk_manifest,
    chunk_size,
    range_pivots,
)
from runweave.operators.ledger import chunk_contents, sorted_runs_with_ledger
from runweave.operators.order_summary import check_summaries, merge_summaries, order_summaries
from runweave.operators.rank_index import positions_of, rows_at, store_sorted
from runweave.operators.ranges import assign_range, range_histogram
from runweave.operators.reports import (
    append_run,
    compare_runs,
    ledger_view,
    node_contribution,
    preview,
    read_runs,
    run_summary,
    scaling_curve,
)
from runweave.operators.run_store import (
    add_run,
    compact_runs,
    merge_stored,
    merge_stored_ranges,
    run_manifest,
    snapshots,
    stored_rows,
    vacuum_runs,
)
from runweave.operators.selection import select_ranks, strided_values
from runweave.operators.sketches import add_run_sketches, run_sketches, sketch_pivots
from runweave.operators.sorting import (
    global_position,
    global_sort,
    index_rows,
    merge_runs,
    position_in_group,
    range_merge,
    sorted_runs,
)
from runweave.operators.validate import (
    audit_seeds,
    check_complete,
    check_conserved,
    check_order,
    check_sorted,
    chunk_report,
)

__all__ = [
    "add_run", "add_run_sketches", "append_run", "apportion", "assign_chunks", "assign_range", "audit_seeds",
    "check_complete", "check_conserved", "check_order", "check_sorted", "check_summaries", "chunk_contents", "chunk_manifest",
    "chunk_report", "chunk_size", "compact_runs", "compare_runs", "global_position",
    "global_sort", "index_rows", "ledger_view", "merge_runs", "merge_stored", "merge_stored_ranges", "merge_summaries",
    "node_contribution", "order_summaries", "position_in_group", "positions_of", "preview", "range_histogram",
    "range_merge", "range_pivots", "read_runs", "rows_at", "run_manifest", "run_sketches", "run_summary", "scaling_curve", "select_ranks",
    "sketch_pivots", "snapshots", "sorted_runs", "sorted_runs_with_ledger", "store_sorted", "stored_rows", "strided_values", "vacuum_runs",
]
