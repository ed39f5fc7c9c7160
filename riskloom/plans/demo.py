"""End to end without a broker: load, engineer, train, evaluate, score a replay, check drift."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from riskloom.operators.decisions import decision_mix, interesting_cases
from riskloom.operators.drift import check_drift, reference_snapshot, two_samples
from riskloom.operators.explain import Explainer
from riskloom.operators.explore import label_totals
from riskloom.operators.features import engineer_features
from riskloom.operators.model import BoostingParams, add_scores
from riskloom.plans import train
from riskloom.plans.session import add_input_arguments, read_input, session
from riskloom.sources.transactions import replay, temporal_split
from riskloom.sources.workspace import fresh_path
from riskloom.streaming.scoring import score_enriched

# Fixed value: rows that the demonstration replays.
REPLAYED = 500


def run(transactions: DataFrame, params: BoostingParams = BoostingParams()) -> dict:
    """The demonstration's tables by name; drift is between the whole splits."""
    spark = transactions.sparkSession
    root = fresh_path(spark, "demo-models")
    model, evaluation, explained = train.run(transactions, root, "demo", True, params)
    explainer = Explainer.load(spark, f"{root}/demo")
    train_rows, test_rows = temporal_split(transactions)

    replayed = engineer_features(replay(test_rows, "test", REPLAYED), "shared")
    scored = train.store(score_enriched(replayed, model, explainer, explain_from=0.05), "demo-scores")

    def sample(rows: DataFrame) -> DataFrame:
        return reference_snapshot(add_scores(engineer_features(rows), model))

    samples = two_samples(sample(train_rows), sample(test_rows))
    summary, tests = check_drift(train.store(samples, "demo-samples"))
    return {
        "split": label_totals(train_rows).unionByName(label_totals(test_rows)),
        "evaluation": evaluation,
        "explained": explained,
        "cases": interesting_cases(scored),
        "decisions": decision_mix(scored),
        "drift": summary,
        "drift_tests": tests,
    }


def main() -> None:
    parser = add_input_arguments(argparse.ArgumentParser(description=__doc__))
    parser.add_argument("--rounds", type=int, default=BoostingParams.rounds)
    args = parser.parse_args()
    spark = session("demo")
    out = run(read_input(spark, args.input, args.format), BoostingParams(rounds=args.rounds))
    evaluation = out.pop("evaluation")
    print(f"PR-AUC {evaluation.pr_auc:.4f}, best F1 {evaluation.best_f1:.4f}")
    evaluation.report.show(truncate=False)
    evaluation.importance.show(5, truncate=False)
    for name, table in out.items():
        print(name)
        table.show(truncate=False)


if __name__ == "__main__":
    main()
