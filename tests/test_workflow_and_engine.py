import pytest

from gleaner.engine import Engine, Options
from gleaner.sources import inventory
from gleaner.workflow import InvalidTransition, Resume, Workflow


def flow():
    return Workflow({k: (lambda root, k=k: f"{k} of {root}") for k in ("exact", "similar", "hygiene")}, clean=lambda results, keepers: keepers)


def test_a_whole_walk():
    w = flow()
    with pytest.raises(InvalidTransition):
        w.advance("StartScan")
    w.advance("SelectFolder", path="/x")
    assert [w.advance(a) for a in ("StartScan", "AcceptExact", "AcceptSimilar", "SkipHygiene")] == ["ReviewingExact", "ReviewingSimilar", "ReviewingHygiene", "Complete"]
    assert w.results == {"exact": "exact of /x", "similar": "similar of /x", "hygiene": "hygiene of /x"}
    with pytest.raises(InvalidTransition):
        w.advance("StartScan")
    assert w.advance("Reset") == "Idle" and w.advance("Cancel") == "Cancelled"


def test_cleaning_looks_for_junk_afresh():
    w = flow()
    w.advance("SelectFolder", path="/x")
    w.advance("StartScan")
    assert w.advance("ConfirmClean", keepers=[1]) == "Complete"
    assert w.results["cleaned"] == [1] and "hygiene" in w.results


def test_resume(tmp_path):
    r = Resume(str(tmp_path / "resume.json"))
    assert r.load() is None
    r.save(str(tmp_path), "exact", 1, 5, now=1000.0)
    assert r.load(now=1000.0 + 3600)["mode"] == "exact" and r.load(now=1000.0 + 25 * 3600) is None
    r.save(str(tmp_path / "gone"), "exact", 1, 5)
    assert r.load() is None
    r.clear()
    r.clear()


def test_engine(spark, tmp_path):
    at = tmp_path / "o.toml"
    at.write_text('strategy = "newest"\nexcludes = ["/data/r1"]\nunknown = 1\n')
    options = Options.from_toml(str(at))
    entries = inventory.entries(spark, "/root/testdata/sf0.001")
    e = Engine(entries, options, inventory.NOW)
    assert e.scan("summary").first().files < entries.where("kind = 'File'").count()
    members = e.exact()
    assert all(r.path.startswith("/data/r0") for r in members.select("path").collect())
    plan = {r.action for r in e.cleanup_plan(members).collect()}
    assert plan <= {"keep", "quarantine", "protected", "changed"}
    assert e.hygiene().count() > 0
    whole = Engine(entries, now=inventory.NOW)
    stages = [whole.scan(s).count() for s in ("candidates", "partial", "full", "compared")]
    assert stages == sorted(stages, reverse=True) and stages[-1] > 0
