"""Run the headline analyses and print one JSON line.

Inputs that are stored once and queried many times (claim graphs, the parsed corpus) are
timed under their own ``load_*`` names, apart from the queries over them.
"""

from __future__ import annotations

import json
import os
import time

from claimweave.plans import ANALYSES, corpus, formula, maintained, shop
from claimweave.session import spark_session

LOADS = {
    "load_shop_graph": shop.shop,
    "load_activity_graph": shop.activity,
    "load_places_graph": maintained.places,
    "load_code_graph": corpus.code_graph,
    "derive_code_dependencies": corpus.dependencies,
    "evaluate_formulas": formula.results,
}
HEADLINE = (
    "orders_per_region containment_closure closure_with_depth closure_by_squaring closure_many_paths "
    "closure_cyclic mutual_recursion nonlinear_rule three_derived_atoms affected_by_changes subtrees "
    "impact_report conjunctive_query claims_about_claims shared_targets shared_target_pair_counts "
    "shared_targets_of_given_pairs hub_groups two_hops three_hops near_names load_tables_as_claims "
    "hide_superseded newest_value value_history claims_as_of state_difference update_properties "
    "rename_keeps_references remove_subtrees lineage_rows insertions_maintained supersessions_maintained "
    "mixed_changes_maintained rule_added_to_views rule_replaced_below_readers long_texts_survive_changes derived_groups contradicting_properties allowed_moves "
    "tagged_transitions target_compliance routed_notifications reevaluated_formulas function_dependencies "
    "top_hubs degrees work_summary streamed_newest_values"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = spark_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name, load in LOADS.items():
        start = time.perf_counter()
        load(spark, folder)
        seconds[name] = round(time.perf_counter() - start, 3)
    # views stored with their derivations: all from nothing, then one customer in a hundred moves
    start = time.perf_counter()
    views = maintained.containment_views(spark, folder)
    seconds["materialize_stored_derivations"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    maintained.moved_views(spark, folder, views)
    seconds["apply_to_stored_derivations"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        ANALYSES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
