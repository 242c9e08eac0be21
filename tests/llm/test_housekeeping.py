"""Line ends, and what operators leave in the shared folder."""

import os

from paperloom.llm import common, quality_rules, sharding


def test_line_ends_do_not_change_verdicts(make):
    line = "This is a sentence of a dozen plain words that ends {k} times with"
    lines = [line.replace("{k}", f"number {k}") + mark for k, mark in enumerate([".", "!", '"', ":", ")", "…", "'", "?"] * 2)]
    rows = [(1, "\n".join(lines)), (2, "\r\n".join(lines)), (3, " \t\n".join(lines)), (4, "\n".join(x[:-1] + "," for x in lines))]
    got = {r.doc_id: r.n_kept_lines for r in quality_rules.clean_lines(make(rows)).collect()}
    assert got == {1: 16, 2: 16, 3: 16, 4: 0}


def test_sharding_removes_what_it_no_longer_reads(make, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: tmp_path.as_uri())
    rows = [(k, f"text {k % 7}" if k % 3 else f"own {k}") for k in range(200)]
    assert sharding.shard_documents(make(rows)).count() == 200
    held = sorted(name.rsplit("-", 1)[0] for name in os.listdir(tmp_path) if not name.startswith("."))
    assert held == ["shard-nodes", "shard-placed"]


def test_slots_and_counts_hold_after_even_dealing(make):
    rows = [(k, "hot" if k % 3 == 0 else f"pair {k // 2}") for k in range(301)]
    got = sharding.shard_documents(make(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(len(v) for v in by.values()) == [37] * 3 + [38] * 5
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
