"""Landing folder to store: checksums, missing files, fourth attempts, corrections, restarts."""

import hashlib
import io
import zipfile
from datetime import datetime

import pytest

from pressmill.streaming import feed, ingest
from tests.test_store import event
from tests.test_stream import TITLE, article, mention

NOW = datetime(2024, 3, 1)
SUFFIX = {"gkg": "gkg.csv.zip", "events": "export.CSV.zip", "mentions": "mentions.CSV.zip"}


def put(folder, slot, kind, lines):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("member.csv", "\n".join(lines))
    (folder / f"{slot}.{SUFFIX[kind]}").write_bytes(data.getvalue())
    return hashlib.md5(data.getvalue()).hexdigest()


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    return folder


def test_cycles(spark, tmp_path, landing):
    new_store = lambda: feed.FeedStore(spark, f"file://{tmp_path}/state", buckets=2, retention=None)
    index = lambda *rows: spark.createDataFrame(rows, "slot string, kind string, md5 string")
    a, b = "20240301000000", "20240301001500"
    rows = [(a, "gkg", put(landing, a, "gkg", [article(1, "a.com", "http://a.com/1", TITLE), "broken"])), (a, "events", put(landing, a, "events", [event(1, "20240301000000")])), (b, "mentions", "0" * 32), (b, "events", "1" * 32)]
    put(landing, b, "mentions", [mention(1, "http://a.com/1", "a")])
    put(landing, "20200101000000", "gkg", ["never asked for"])
    states = lambda s: {(r.slot, r.kind): (r.status, r.attempts, r.row_count) for r in s.slots.read().collect()}

    store = new_store()
    ingest.cycle(store, f"file://{landing}", index(*rows), 0, NOW)
    assert states(store) == {(a, "gkg"): ("published", 0, 2), (a, "events"): ("published", 0, 1), (b, "mentions"): ("pending", 1, None), (b, "events"): ("pending", 1, None)}
    assert store.articles.read().count() == store.dead.read().count() == store.events.read().count() == 1 and store.mentions.read().count() == 0

    # The same cycle again, and another process: nothing changes, nothing is lost.
    ingest.cycle(store, f"file://{landing}", index(*rows), 0, NOW)
    store = new_store()
    assert states(store)[b, "mentions"] == ("pending", 1, None)

    # The index corrects a checksum; the missing file fails at its fourth attempt and is not asked for any more.
    good = hashlib.md5((landing / f"{b}.mentions.CSV.zip").read_bytes()).hexdigest()
    ingest.cycle(store, f"file://{landing}", index((b, "mentions", good)), 1, NOW)
    assert states(store)[b, "mentions"] == ("published", 1, 1) and store.mentions.read().count() == 1
    for batch in (2, 3, 4):
        ingest.cycle(store, f"file://{landing}", index(), batch, NOW)
    assert states(store)[b, "events"] == ("failed", 4, None)

    # Forced, a published slot is read once more, which changes no row, and a failed one gets its chance.
    late = put(landing, b, "events", [event(2, "20240301000000")])
    ingest.cycle(store, f"file://{landing}", index((b, "events", late)), 5, NOW, force=spark.createDataFrame([(a, "gkg"), (b, "events")], "slot string, kind string"))
    assert states(store)[b, "events"][0] == "published" and states(store)[a, "gkg"] == ("published", 0, 2)
    assert store.events.read().count() == 2 and store.articles.read().count() == 1 and store.dead.read().count() == 1
