"""Documents of responses: good, incomplete and wrong ones."""

from __future__ import annotations

import copy
import json

import pytest

from aerolake.sources import response_tables as rt

GOOD = {
    "meta": {"status": "complete", "grid": "10m"}, "dirs": [22.5 * i for i in range(16)], "classes": ["AC", "D", "EF"], "groups": ["A", "B", "C", "D"],
    "gamma": [[[0.1 * d, 0.2, 0.0, 1.0] for _ in range(3)] for d in range(16)], "age": [[[1.0] * 4 for _ in range(3)] for _ in range(16)],
    "band": [[[[0.0, 1.0]] * 4 for _ in range(3)] for _ in range(16)], "wind": [{"s4": 1.0, "s10": 2.0, "dir4": 3.0, "dir10": 4.0}] * 16, "quality": [[{"converged": True, "mass_ok": True}] * 3] * 16,
}


def changed(**put):
    doc = copy.deepcopy(GOOD)
    for path, v in put.items():
        *way, last = [int(x) if x.isdigit() else x for x in path.split("__")]
        at = doc
        for x in way:
            at = at[x]
        if v is KeyError:
            del at[last]
        else:
            at[last] = v
    return doc


CASES = {
    "good": (GOOD, []),
    "keys": (changed(gamma=KeyError, wind=KeyError), [("error", "missing key 'gamma'"), ("error", "missing key 'wind'")]),
    "dirs": (changed(dirs__3=68.0), [("error", "dirs must be the 16 directions from 0")]),
    "groups": (changed(groups=["A", "B", "D", "C"]), [("error", "groups must be A, B, C, D")]),
    "classes": (changed(classes=["AC", "D", "X"]), [("error", "classes must be some of AC, D, EF, A, B, C, E, F")]),
    "short": (changed(age=[[[1.0] * 4] * 3] * 15), [("error", "age must have 16 directions")]),
    "row": (changed(gamma__4=[[1.0] * 4] * 2), [("error", "gamma[4] must have 3 classes")]),
    "cell": (changed(gamma__4__1=[1.0] * 3, band__0__2=[[0.0, 1.0, 2.0]] * 4, age__9__0=[1.0, None, 1.0, 1.0]), [("error", "age[9][0] has non-finite values"), ("error", "band[0][2] must hold [min, max] pairs"), ("error", "gamma[4][1] must have 4 groups")]),
    "negative": (changed(gamma__15__2=[0.0, 0.0, -0.1, 0.0]), [("error", "gamma[15][2] has negative values")]),
    "wind": (changed(wind__2={"s4": 1.0, "s10": 1.0, "dir4": 1.0}, wind__3=None), [("error", "wind[2] needs s4, s10, dir4, dir10"), ("warning", "wind[3] missing")]),
    "missing": (changed(gamma__0__0=None, gamma__5__1=None, quality=KeyError), [("warning", "2 of 48 gamma entries are null"), ("warning", "no quality of the entries")]),
    "poor": (changed(quality__0=[{"converged": False}, {"mass_ok": False}, {}]), [("warning", "2 entries did not converge or miss the mass tolerance")]),
}


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, (doc, _) in CASES.items():
        (folder / f"{name}.json").write_text(json.dumps(doc, indent=1))
    return rt.read(spark, str(folder))


def test_problems(documents):
    got: dict = {}
    for p in rt.problems(documents).collect():
        got.setdefault(p.file.removesuffix(".json"), []).append((p.level, p.message))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, (_, v) in CASES.items() if v}


def test_rows_of_good_documents(documents):
    got: dict = {}
    for r in rt.rows(documents).collect():
        got.setdefault(r.file.removesuffix(".json"), []).append(r)
    assert {k: len(v) for k, v in got.items()} == {"good": 48, "missing": 46, "poor": 48}
    one = next(r for r in got["good"] if r.direction == 45.0 and r.grp == "D")
    assert list(one.gamma) == pytest.approx([0.2, 0.2, 0.0, 1.0]) and list(one.age) == [1.0] * 4 and [list(b) for b in one.band] == [[0.0, 1.0]] * 4
