import pytest

from factlens.plans import testbed

#: View to the events that it is made of; the last event has no successor.
WHOLE = {
    "calls": "event_type IN ('error', 'signup')",
    "instantiates": "event_type = 'purchase'",
    "refs": "event_type = 'view'",
    "imports": "event_type = 'click'",
    "reexport": "event_type = 'click'",
    "runtime": "event_type IN ('error', 'purchase', 'view')",
}


@pytest.mark.parametrize("view", WHOLE)
def test_every_event_of_a_kind_is_projected(duck, view):
    made = duck.sql(testbed.with_views(f"SELECT ord FROM {{{view}}} ORDER BY ord")).fetchall()
    events = duck.sql(f"SELECT event_id FROM events WHERE {WHOLE[view]} AND event_id < (SELECT max(event_id) FROM events) ORDER BY event_id").fetchall()
    assert made == events and made


def test_snapshots_fingerprint_whole_texts(duck):
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (0, 'the same opening, one', 'en', 21), (10, 'the same opening, two', 'en', 21), (20, 'the same opening, one', 'en', 21)) d(doc_id, text, lang, n_chars)")
    for view in ("snap_a", "snap_b"):
        one, two, copy = c.sql(testbed.with_views(f"SELECT fp, structureId FROM {{{view}}} ORDER BY ord")).fetchall()
        assert one != two and one == copy
    texts = duck.sql("SELECT count(DISTINCT text) FROM documents").fetchall()
    assert duck.sql(testbed.with_views("SELECT count(DISTINCT fp) FROM {snap_a}")).fetchall() == texts
