import json
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attrition.session import checkpoint_dir, local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"

BASE_MS = 1_704_067_200_000  # 2024-01-01 00:00:00 UTC
HOUR = 3_600_000
DAY = 24 * HOUR


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="attrition-tests")
    checkpoint_dir(s)
    yield s


def event(user, t_ms, page="NextSong", level="paid", session=1, **kw):
    row = {"userId": user, "sessionId": session, "ts": t_ms, "registration": kw.pop("registration", BASE_MS - 10 * DAY),
           "page": page, "level": level, "gender": kw.pop("gender", "F"),
           "length": kw.pop("length", 100.0 if page == "NextSong" else None),
           "artist": kw.pop("artist", "A" if page == "NextSong" else None),
           "userAgent": kw.pop("userAgent", "Mozilla/5.0 (Windows NT 6.1) Chrome/36.0 Safari/537.36"),
           "location": "X", "auth": "Logged In", "status": 200}
    row.update(kw)
    return row


@pytest.fixture
def jsonl(tmp_path):
    """Write rows (dicts or raw strings) as a JSON-Lines file, return its path."""
    counter = {"n": 0}

    def write(rows):
        counter["n"] += 1
        p = tmp_path / f"events{counter['n']}.json"
        with open(p, "w") as f:
            for r in rows:
                f.write((r if isinstance(r, str) else json.dumps(r)) + "\n")
        return str(p)

    return write
