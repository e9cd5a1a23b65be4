"""Several wordings in one leaf of operator 7's tree, against the SQL twin over the same rows."""

import duckdb
import pandas as pd
import pytest

from gleaner.llm import line_templates, shared

LEAD = "status of job"


def wording(kind, value, size=12, field=6):
    """One wording of a leaf: the lead is common to all, the other tokens are its own, one of them variable."""
    tokens = LEAD.split() + [f"w{chr(97 + kind)}{chr(97 + i)}" for i in range(size - 3)]
    tokens[field] = f"v{'abcdefghij'[value // 10]}{'abcdefghij'[value % 10]}x"
    return " ".join(tokens)


def check(spark, texts):
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = line_templates.report(spark.createDataFrame(frame).coalesce(1)).toPandas()
    with duckdb.connect() as db:
        db.register("documents", frame)
        want = db.sql(line_templates.sql()).df()
    key = got.columns.tolist()
    assert got.sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()
    return got


@pytest.mark.parametrize("large", [20_000, 1])
def test_equal_wordings_come_apart(spark, monkeypatch, large):
    monkeypatch.setattr(line_templates, "LARGE", large)
    got = check(spark, [wording(k, 10 * k + i) + f"\n{'abcde'[k] * 4} {'uvwxyz'[i] * 4} alone" for k in range(5) for i in range(6)])
    assert got.n_dropped.sum() == 25 and (got.n_dropped == 0).sum() == 5


def test_any_number_of_wordings(spark):
    got = check(spark, [wording(k, i) for k in range(14) for i in range(6 + 2 * k)])
    assert got.n_dropped.sum() == sum(5 + 2 * k for k in range(14))


def test_a_field_with_common_values(spark):
    """Half of the lines share a field's value with other wordings; each half is a branch, the rest another."""
    texts = [" ".join(t if j != 4 or i % 2 else "often" for j, t in enumerate(wording(k, i).split(" "))) for k in range(4) for i in range(24)]
    got = check(spark, texts)
    assert got.n_dropped.sum() >= 4 * 22  # of each wording, one line of each branch stays at most


def test_unlike_lines_of_a_leaf_stay(spark):
    texts = [LEAD + " " + " ".join(f"q{chr(97 + (i * 7 + j * 11) % 26)}{chr(97 + (i * 5 + j) % 26)}{i}".translate(str.maketrans("0123456789", "klmnopqrst")) for j in range(9)) for i in range(40)]
    assert check(spark, texts).n_dropped.sum() == 0


def test_only_wordings_of_shared_leaves_are_taken_apart(spark, monkeypatch):
    """However full the bitmap is, lines of other leaves are left out."""
    monkeypatch.setattr(shared, "CELLS", 64)
    seen, groups = [], line_templates._groups
    monkeypatch.setattr(line_templates, "_groups", lambda wordings, *limits: seen.append(wordings) or groups(wordings, *limits))
    alone = lambda i, j: f"{'abcdefghij'[i]}{'uvwxyzpqrs'[j]}own line here alone"
    got = check(spark, [wording(0, i) + "".join(f"\n{alone(i, j)}" for j in range(10)) for i in range(10)])
    assert got.n_dropped.sum() == 9
    assert {r.wording for r in seen[0].collect()} == {wording(0, i) for i in range(10)}
