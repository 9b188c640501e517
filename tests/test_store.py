"""Kept stages: found for the same files, rules and controls, missed for others, deleted by age."""

import json
import os
import time
from dataclasses import replace
from datetime import date

import pytest

from costweave import cli, config
from costweave.plans import store as module
from costweave.plans.sinks import snapshot
from costweave.plans.store import StageStore, input_fingerprint
from costweave.sources import star_schema

FOLDER = "/root/testdata/sf0.001"
BASE = {"base_date": date(2000, 12, 31), "fast_mode": True}


def missing():
    raise AssertionError("read again")


def test_a_second_run_reads_no_lines(spark, tmp_path):
    resolved = config.resolve({}, BASE)
    first = StageStore(spark, str(tmp_path / "kept"), "f", vars(resolved.controls))
    tables, summary = cli.run_tables(lambda: star_schema.po_lines(spark, FOLDER), resolved, keep=first)
    assert first.built == ["classified", "known", "daily", "pairs", "weighted"] and not first.hits
    second = StageStore(spark, str(tmp_path / "kept"), "f", vars(resolved.controls))
    again, _ = cli.run_tables(missing, resolved, keep=second)
    assert second.hits == first.built and not second.built
    for name in ("bucket_weights", "composite_forecast", "committed_signal"):
        assert sorted(map(str, tables[name].collect())) == sorted(map(str, again[name].collect()))
    other = StageStore(spark, str(tmp_path / "kept"), "f", vars(replace(resolved.controls, huber_delta=2.0)))
    with pytest.raises(AssertionError, match="read again"):
        cli.run_tables(missing, resolved, keep=other)


@pytest.fixture
def kept(spark, tmp_path):
    def at(fingerprint="f", **controls):
        return StageStore(spark, str(tmp_path / "kept"), fingerprint, controls)

    return at


def numbers(spark):
    return lambda: spark.range(7)


def test_keys(spark, kept, monkeypatch):
    assert kept()(numbers(spark), "a").count() == 7
    assert kept()(missing, "a").count() == 7
    for store, stage in ((kept(), "b"), (kept("g"), "a"), (kept(x=1), "a")):
        with pytest.raises(AssertionError):
            store(missing, stage)
    monkeypatch.setattr(module, "RULES", "other")
    with pytest.raises(AssertionError):
        kept()(missing, "a")


def test_a_stage_that_fails_is_not_there(spark, kept):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        kept()(lambda: spark.sql("select 1 / (id - id) as x from range(3)"), "a")
    assert kept()(numbers(spark), "a").count() == 7


def test_invalidated_and_lost_tables_are_built_again(spark, kept, tmp_path):
    store = kept()
    store(numbers(spark), "a")
    store.invalidate("a")
    store.invalidate("never there")
    assert kept()(lambda: spark.range(3), "a").count() == 3
    marker = next(p for p in (tmp_path / "kept").glob("a-*.json"))
    table = tmp_path / "kept" / json.loads(marker.read_text())["table"]
    (table / "_SUCCESS").unlink()
    assert kept()(lambda: spark.range(2), "a").count() == 2


def test_sweep(spark, kept, tmp_path):
    assert kept().sweep(1) == []
    store = kept()
    store(numbers(spark), "old")
    store(numbers(spark), "new")
    (tmp_path / "kept" / "half-written").mkdir()
    old = time.time() - 3 * 86_400
    for p in [*(tmp_path / "kept").glob("old-*"), tmp_path / "kept" / "half-written", *(p for p in (tmp_path / "kept").glob("new-*") if p.is_dir())]:
        os.utime(p, (old, old))
    gone = store.sweep(2)
    assert "half-written" in gone and sum(g.startswith("old-") for g in gone) >= 2 and not any(g.startswith("new-") for g in gone)
    assert kept()(missing, "new").count() == 7
    with pytest.raises(AssertionError):
        kept()(missing, "old")


def test_fingerprints_follow_contents_and_names(spark, tmp_path):
    def written(folder, **files):
        (tmp_path / folder).mkdir()
        for name, text in files.items():
            (tmp_path / folder / f"{name}.csv").write_text(text)
        return input_fingerprint(snapshot(spark, [str(tmp_path / folder)]))

    one = written("one", a="1", b="2")
    assert one == written("copy", b="2", a="1")
    assert len({one, written("changed", a="1", b="3"), written("swapped", a="2", b="1"), written("more", a="1", b="2", c="2"), written("renamed", a="1", c="2")}) == 5


def test_a_run_that_fails_keeps_nothing(spark, tmp_path, monkeypatch):
    args = ["run", "--input", FOLDER, "--format", "star", "--base-date", "2000-12-31", "--fast", "--no-bands", "--cache", str(tmp_path / "kept")]

    def refuse(*a, **k):
        raise ValueError("inputs changed during the run")

    monkeypatch.setattr(cli, "write_package", refuse)
    with pytest.raises(ValueError, match="inputs changed"):
        cli.main([*args, "--output", str(tmp_path / "a")])
    assert not list((tmp_path / "kept").glob("*.json"))
