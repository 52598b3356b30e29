import duckdb
import numpy as np
import pytest

from loomline.llm import embedding_dedup as ed

VEC = "vec_id bigint, embedding array<float>, label int, uid bigint, area string, n int, cell int, links int, home int"
MORE = (1, "a", 2, 3, 4, 5)


def dedup(spark, tmp_path, rows):
    folder = str(tmp_path / "t")
    spark.createDataFrame([(*r, *MORE) for r in rows], VEC).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    df = ed.op13_embedding_dedup(spark, folder)
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    got, want = sorted((tuple(r) for r in df.collect()), key=key), sorted(db.sql(ed.OP13_SQL).fetchall(), key=key)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert got == want
    return got


def near(rng, v, noise):
    return v / np.linalg.norm(v) + rng.normal(0, noise / np.sqrt(len(v)), len(v))


def made(rng, tight=150, loose=60, chain=40, others=400, d=16):
    """A tight group, a loose one whose pairs lie on both sides of the threshold, a chain, exact copies, and vectors alone."""
    rows, centre = [], rng.normal(size=d)
    rows += [near(rng, centre, 0.08) for _ in range(tight)]
    rows += [near(rng, -centre, 0.2) for _ in range(loose)]
    a, b = np.linalg.qr(rng.normal(size=(d, 2)))[0].T
    rows += [np.cos(t) * a + np.sin(t) * b for t in np.arange(chain) * 0.15]
    rows += [rows[0]] * 5 + [3 * rows[1]] * 2
    rows += list(rng.normal(size=(others, d)))
    return [(i, [float(x) for x in v], int(rng.integers(0, 2)) if i >= tight + loose else 0) for i, v in enumerate(rows)]


@pytest.mark.parametrize("per_cell", [4000, 40])
def test_groups_against_sql(spark, tmp_path, monkeypatch, per_cell):
    monkeypatch.setattr(ed, "PER_CELL", per_cell)  # read by the driver
    monkeypatch.setattr(ed, "BLOCK", 50)
    got = dedup(spark, tmp_path, made(np.random.default_rng(per_cell)))
    assert max(r[1] for r in got) >= 150 and sum(not r[3] for r in got) > 200


def test_odd_rows(spark, tmp_path):
    v, w = [1.0, 2.0, 2.0], [2.0, 4.0, 4.1]
    rows = [
        (1, v, 1),
        (1, v, 1),
        (2, w, 1),
        (3, v, 2),
        (4, v, None),
        (5, None, 1),
        (6, [], 1),
        (7, [0.0, 0.0, 0.0], 1),
        (8, [1.0, None, 2.0], 1),
        (9, [1.0, float("nan"), 2.0], 1),
        (10, [1.0, float("inf"), 2.0], 1),
        (None, v, 1),
        (None, None, None),
        (11, [1.0, 2.0], 1),
        (12, [1e30, 2e30, 2e30], 1),
        (13, [1e-30, 2e-30, 2e-30], 1),
        (14, [-1.0, -2.0, -2.0], 1),
        (2, [9.0, 0.0, 0.0], 1),
        (5, v, 2),
    ]
    got = dedup(spark, tmp_path, rows)
    assert len(got) == len(rows)
    assert [r[2] for r in got if r[0] in (1, 2, 12, 13)] == [1] * 6 and (14, 0, 14, True) in got and (4, 0, 4, True) in got


def test_no_rows(spark, tmp_path):
    assert dedup(spark, tmp_path, []) == []


def test_equal_vectors_are_compared_once(spark):
    copies = spark.range(3000).selectExpr("id as vec_id", "array(1D, 2D, 3D) as embedding", "1 as label")
    r = ed.near_duplicates(copies).selectExpr("min(n_links)", "max(n_links)", "max(component_id)", "count_if(kept)").first()
    assert tuple(r) == (2999, 2999, 0, 1)
