"""Command line: ``python -m axonframe list | query NAME DIR [OUT] | compare TRIALS.csv OUT [--reference ARM]``, and
``run | sweep | dose | scenarios CIRCUIT OUT`` on a stored circuit, ``rates SPIKES OUT`` of a run's spikes."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from axonframe.functions.special import normal_p_value
from axonframe.operators import stats as S
from axonframe.plans.all import ORACLE, QUERIES
from axonframe.session import session
from axonframe.sources import tables as T


def compare(path: str, out: str, reference: str | None) -> None:
    """From a wide trial table: a description by arm, all contrasts, and equivalence to a reference arm, each a CSV."""
    spark = session()
    long = T.checkpointed(S.to_long(T.read_trials(spark, path), ["arm", "trial"]))
    good = long.filter("finite")
    T.write_csv(S.describe(long).orderBy("metric", "arm"), f"{out}/compare", {"sem": "standard error", "q1": "exclusive quartile", "n_excluded": "values that are not finite"})
    stats = T.checkpointed(S.moments(good))
    c = S.contrasts(S.arm_pairs(stats))
    mw = S.mann_whitney(S.pooled_values(good, c)).withColumn("p_mw", normal_p_value("z"))
    pairs = S.with_p_values(c).join(mw, ["metric", "a", "b"])
    T.write_csv(S.holm(pairs, ["metric"], "p", ["a", "b"]).orderBy("metric", "a", "b"), f"{out}/pairs")
    if reference:
        e = S.contrasts(S.arm_pairs(stats, reference))
        t = F.col("diff") / F.nullif(F.col("pooled_sd") * F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b")), F.lit(0.0))
        e = S.equivalence(e).withColumn("bf10", S.bayes_factor(t, F.col("n_a"), F.col("n_b")))
        T.write_csv(e.orderBy("metric", "a"), f"{out}/equivalence")


def experiment(a: argparse.Namespace) -> None:
    """One of the experiments on a binary circuit; spikes as Parquet, tables as CSV."""
    from axonframe.operators import experiments as X
    from axonframe.operators import readout as R
    from axonframe.sources.circuit import read_blob

    spark = session()
    if a.what == "rates":
        spikes = T.read_parquet(spark, a.circuit).select(F.col("exp_name").alias("arm"), F.col("id").alias("neuron"), "trial", "t")
        T.write_csv(R.firing_rates(spikes, a.seconds, a.trials).orderBy("arm", "neuron"), a.out, {"rate": "spikes a second over all runs", "sd": "deviation over runs"})
        return
    tables = read_blob(spark, a.circuit)
    if a.what == "run":
        X.run_exp(tables, a.name, a.excite, a.excite2, a.silence, a.hz, a.hz2, a.seconds, a.trials).write.mode("overwrite").parquet(a.out)
        return
    c, edges, of, pools = X.opened(tables)
    view = pools.get("self_motion", pools["odor"])
    if a.what == "sweep":
        out = X.gain_sweep(c, edges, of, pools["odor"], a.kappas, a.seconds).orderBy("arm", "population")
    elif a.what == "dose":
        out = X.dose(spark, c, view, a.fracs, a.trials, a.seconds).orderBy("frac", "trial")
    else:
        out = X.scenarios(c, of, {"smell": pools["odor"], "taste": pools["sugar"], "danger": pools["motor"], "view": view}, a.seconds).orderBy("scenario", "population")
    T.write_csv(out, a.out)


def main() -> None:
    p = argparse.ArgumentParser(prog="axonframe", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="names of all queries")
    q = sub.add_parser("query", help="run one over a folder of Parquet tables")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("dir")
    q.add_argument("out", nargs="?", help="Parquet folder; without it, rows are shown")
    c = sub.add_parser("compare", help="statistics of a CSV of trials")
    c.add_argument("csv")
    c.add_argument("out")
    c.add_argument("--reference")
    for name, text in (("run", "spikes of a circuit"), ("sweep", "rates by scale of the weights"), ("dose", "dose of the patch"), ("scenarios", "five scenarios"), ("rates", "rates of cells from spikes")):
        e = sub.add_parser(name, help=text)
        e.add_argument("circuit")
        e.add_argument("out")
        e.add_argument("--seconds", type=float, default=1.0)
        e.add_argument("--trials", type=int, default=30 if name in ("run", "rates") else 10)
        if name == "run":
            e.add_argument("--name", default="run")
            for ids in ("--excite", "--excite2", "--silence"):
                e.add_argument(ids, type=int, nargs="*", default=[])
            e.add_argument("--hz", type=float, default=150.0)
            e.add_argument("--hz2", type=float, default=0.0)
        elif name == "sweep":
            e.add_argument("--kappas", type=float, nargs="+", default=[0.5, 1.0, 2.0])
        elif name == "dose":
            e.add_argument("--fracs", type=float, nargs="+", default=[0.0, 0.25, 0.5, 0.75, 1.0])
    a = p.parse_args()
    if a.what == "list":
        print(*(f"{n}{'' if n in ORACLE else ' (no SQL)'}" for n in sorted(QUERIES)), sep="\n")
    elif a.what == "compare":
        compare(a.csv, a.out, a.reference)
    elif a.what != "query":
        experiment(a)
    else:
        df = QUERIES[a.name](session(), a.dir)
        df.show(50, truncate=False) if a.out is None else df.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
