import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    names = {n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    oracles = {n for n in entry.oracle_sql() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert oracles <= names and len(names) > 70
    # Queries without SQL are the fitted models and what depends on them.
    assert names - oracles == {"language_id", "density_cluster", "sentiment_model", "narrative_analysis",
                                               "record_languages", "reduce_dimensions",
                                               "near_pairs_projected", "reachability_clusters", "language_segments"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["category", "lang_bucket", "n"] and df.count() > 0


def test_no_local_checkpoints_or_cross_joins():
    for file in (ROOT / "narrascope").rglob("*.py"):
        source = re.sub(r'""".*?"""|f?"""', "", file.read_text(), flags=re.S)
        assert "localCheckpoint" not in source and ".crossJoin" not in source and "toPandas" not in source, file
