"""The data source for CSV folders: plans, pieces and rows against Spark's own reader."""

import random

import pytest

from profilia.sources import csv_folder, tables


def folder(tmp_path):
    rng = random.Random(3)
    (tmp_path / "x" / "y").mkdir(parents=True)
    names = ["API_WellNo", "RptDate", "BBLS_OIL_COND", "MCF_GAS", "BBLS_WTR", "DAYS_PROD"]
    for k in range(9):
        head = rng.sample(names, len(names) - (k % 2)) if k else names
        head = head if "API_WellNo" in head and "RptDate" in head else names
        rows = []
        for i in range(rng.randint(0, 120)):
            one = {"API_WellNo": f'"w, {k} é"' if i % 7 == 0 else f"w{k}", "RptDate": f"2024-{1 + i % 12:02d}-01" if i % 11 else "bad", "BBLS_OIL_COND": i, "MCF_GAS": "" if i % 5 == 0 else i / 4, "BBLS_WTR": "NaN" if i % 13 == 0 else -i, "DAYS_PROD": 30}
            rows.append(",".join(str(one[c]) for c in head))
            if i % 17 == 3:
                rows.append(rows[-1] + ",more")
            if i % 19 == 4:
                rows.append(",".join(str(one[c]) for c in head[:-2]))
            if i % 23 == 5:
                rows.append("")
        end = "\r\n" if k == 2 else "\n"
        text = ("\ufeff" if k == 1 else "") + ",".join(head) + end + end.join(rows) + ("" if k == 3 else end)
        (tmp_path / ("x/y" if k % 3 == 0 else "x" if k % 3 == 1 else "") / f"f{k}.csv").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "x" / "none.csv").write_text("")
    (tmp_path / "x" / "head.csv").write_text("API_WellNo,RptDate")
    (tmp_path / "x" / "other.txt").write_text("API_WellNo,RptDate\nz,2024-01-01\n")
    (tmp_path / "_old.csv").write_text("API_WellNo,RptDate\nz,2024-01-01\n")
    return f"file://{tmp_path}"


def test_same_rows_as_sparks_reader(spark, tmp_path):
    path = folder(tmp_path)
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(tables.read_production_csv(spark, path, planned=False))
    assert len(want) > 200
    assert rows(tables.read_production_csv(spark, path)) == want


@pytest.mark.parametrize("split", [1, 37, 1000, 1 << 20])
def test_each_byte_belongs_to_one_piece(tmp_path, split):
    """Pieces of a file follow each other from its data's first byte to its end, and their lines are the file's, whatever the size of the pieces."""
    path = folder(tmp_path)
    pieces, text = {}, {}
    for part in csv_folder.plan(path, split):
        assert sum(end - start for _, start, end, _, _ in part.pieces) <= split
        for p, start, end, head, begin in part.pieces:
            assert "API_WellNo" in part.headers[head]
            pieces.setdefault(p, [(begin, begin)]).append((start, end))
            with open(p, "rb") as f:
                text[p] = text.get(p, b"") + csv_folder._lines(f, start, end, begin)
    assert len(pieces) >= 7
    for p, cuts in pieces.items():
        whole = open(p, "rb").read()
        assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False)) and cuts[-1][1] == len(whole)
        assert text[p] == whole[cuts[0][0] :]


def test_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\n\xef\xbb\xbfk,v\n1,x\nbad,\"\"\n2,\xff\n")
    (tmp_path / "b.csv").write_text("v,w.x\ny,3\n")
    path = f"file://{tmp_path}"
    assert csv_folder.read_csv_folder(spark, path).columns == ["k", "v", "w.x"]
    got = csv_folder.read_csv_folder(spark, path, "`w.x` int, k long, v string, q double", split_bytes=5)
    assert [t for _, t in got.dtypes] == ["int", "bigint", "string", "double"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 1, "x", None), (None, None, "", None), (None, 2, "\ufffd", None), (3, None, "y", None)], key=str)
    assert csv_folder.read_csv_folder(spark, f"{path}/a.csv", "k long").where("k is not null").count() == 2
    (tmp_path / "empty").mkdir()
    assert csv_folder.read_csv_folder(spark, f"{path}/empty", "k long").count() == 0
