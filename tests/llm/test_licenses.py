import math
import re
from collections import Counter

from stratalog.llm.licenses import TEMPLATES, licence_bodies, scan_licenses
from stratalog.llm.shared import Workspace

FILLER = "some plain prose about rivers and hills that goes on for quite a while without any statement"


def fixture():
    mit, apache = TEMPLATES["MIT"][0], TEMPLATES["Apache-2.0"][1]
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x.txt", FILLER), (3, "a/b/c/deep.txt", FILLER), (4, "a/b/LICENSE", apache), (5, "a/b/own.txt", f"{FILLER}\n{mit}\n{FILLER}"),
        (6, "other/file", FILLER), (7, None, FILLER), (8, "a/b/null", None), (9, "a/b/empty", ""), (10, "top.txt", FILLER), (11, "a2/no", FILLER),
        (12, "late/x", f"{FILLER} " * 400 + "\n  Licensed under CC BY-NC 4.0.\n"), (2, "a/x.txt", FILLER), (None, "a/b/c/nokey", FILLER), (13, "a/LICENSE.2", apache),
    ]
    return [*rows, *[(100 + i, f"m/{i}", f"{FILLER} {i}\nThe license of a bird is under the tree number {i}") for i in range(60)]]


def brute(rows, least, share):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    df = Counter(w for _, _, t in rows for w in set(split(t or "")))
    known = {w for named in (TEMPLATES, licence_bodies()) for ts in named.values() for t in ts for w in split(t)}
    idf = lambda w: math.log((len(rows) + 1) / (df[w] * (w in known) + 1)) + 1
    vector = lambda ws: {w: (1 + math.log(n)) * idf(w) for w, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    flat = [(name, vector(split(t))) for name, ts in TEMPLATES.items() for t in ts]
    found = []
    for i, p, t in rows:
        best, covered, total = (0.0, None), 0, 0
        for line in (t or "").split("\n"):
            if ws := split(line):
                v = vector(ws)
                c, name = max(((sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u), n) for n, u in flat), key=lambda q: q[0])
                total += len(ws)
                covered += len(ws) * (c >= least)
                best = max(best, (c, name), key=lambda q: q[0])
        found.append((i, p, best[1] if best[0] >= least else None, covered >= share * max(1, total), best[0]))
    dirs = {}
    for i, p, name, file, c in found:
        if p and name and file:
            d = p.rpartition("/")[0]
            dirs[d] = max(dirs.get(d, (0, 0, None)), (round(c, 6), -(i or 0), name))
    out = []
    for i, p, name, file, _ in found:
        d, at = (p or "").rpartition("/")[0], None
        while p and name is None:
            if d in dirs:
                at = d
                break
            if not d:
                break
            d = d.rpartition("/")[0]
        out.append(str((i, p, name, file, name or (dirs[at][2] if at is not None else None), at)))
    return sorted(out)


def test_matches_brute_force(spark):
    rows = fixture()
    frame = spark.createDataFrame([(i, p, t, "x") for i, p, t in rows], "doc_id long, path string, text string, dir string")
    got = scan_licenses(frame.repartition(3), Workspace(spark, "t")).collect()
    assert sorted(str((r.doc_id, r.path, r.own_license, r.license_file, r.license, r.inherited_from)) for r in got) == brute(rows, 0.75, 0.5)
    by = {r.doc_id: r for r in got}
    assert by[12].license == "CC-BY-NC-4.0" and by[3].license == "Apache-2.0" and by[3].inherited_from == "a/b" and by[100].license is None


def test_a_very_long_line(spark):
    rows = [(1, "x/LICENSE", " ".join(t for t in licence_bodies()["MIT"]).replace("\n", " ")), (2, "x/long", f"{FILLER} " * 40_000), (3, None, None)]
    by = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), Workspace(spark, "t")).collect()}
    assert by[1].license_file and by[2].own_license is None and by[2].license == "MIT" and by[3].license is None


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, path string, text string")
    assert scan_licenses(frame, Workspace(spark, "t")).count() == 0


def test_whole_and_wrapped_licences(spark):
    bodies = {name: texts[0] for name, texts in licence_bodies().items()}
    rows = [(k, f"{name}/LICENSE", text.replace("<year>", "2021").replace("<copyright holders>", "Jo Doe")) for k, (name, text) in enumerate(bodies.items())]
    rows += [(100 + k, f"{name}/src/x", FILLER) for k, name in enumerate(bodies)]
    notice = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    code = "\n".join(f"value{i} = compute(river{i}, hill{i})" for i in range(60))
    comment = lambda t, mark: "".join(f"{mark} {x}\n" for x in t.split("\n"))
    wrapped = {200: comment(notice, "#"), 201: comment(notice, " *"), 202: f"/*\n{notice}\n*/\n", 203: notice + "\n\n", 204: f"// short\n{comment(notice, '//')}"}
    rows += [(k, f"code/{k}", t + code) for k, t in wrapped.items()]
    rows += [(300, "code/300", comment(bodies["MIT"], "//") + code), (301, "code/301", f"{code}\n\n{FILLER}\n{FILLER}")]
    rows += [(1000 + i, f"m/{i}", f"{FILLER} {i}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string")
    by = {r.doc_id: r for r in scan_licenses(frame, Workspace(spark, "t")).collect()}
    for k, name in enumerate(bodies):
        assert (by[k].own_license, by[k].license_file) == (name, True), (name, by[k])
        assert (by[100 + k].license, by[100 + k].inherited_from) == (name, name)
    assert {k: by[k].own_license for k in wrapped} == dict.fromkeys(wrapped, "GPL-3.0")
    assert not any(by[k].license_file for k in wrapped)
    assert by[300].own_license == "MIT" and by[301].license is None
