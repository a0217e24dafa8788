"""Small tables for the corpus operators: a few clean ones, dirty ones, and empty ones."""

import math
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def _documents() -> list[tuple]:
    long = " ".join(f"word{i % 977} sequence{i % 13}" for i in range(9000))
    base = " ".join(f"term{i}" for i in range(60))
    rows = [
        (5, base, "en", "a"),
        (6, base, "en", "a"),  # exact copy
        (7, base + " x", "en", "b"),  # near copy
        (8, "", "en", "b"),
        (9, None, None, None),
        (10, long, "en", "a"),
        (11, f"start {PASSAGE.upper()} end", "en", "a"),
        (12, f"one two three {long[:4000]} {PASSAGE}", "de", "a"),
        (13, "Released under the MIT License.\nmore mit license words", "en", "c"),
        (14, "Licensed under CC BY-NC 4.0. Under the MIT-license", "en", "c"),
        (15, "This work is licensed under the GNU General Public License, version 3.", "en", "c"),
        (16, "  <|endoftext|>  tabs\tand\n\nlines  ", "en", "c"),
        (17, "é É ǰ J̌ İ K ΑΣ ſ 你好 　wide", "fr", "c"),
        (18, "short item", "en", "c"),
        (18, "short item", "en", "c"),  # repeated row
        (19, "the same key", "en", "c"),
        (19, "with another text", "en", "d"),
        (None, "a text without a key", "en", "d"),
        (20, "!!! ??? ---", "en", "d"),
        (21, "a", "en", "d"),
    ]
    return rows


@pytest.fixture(scope="session")
def folders(tmp_path_factory) -> dict[str, str]:
    """Folders of tables by name: sf, dirty (extra columns included), empty."""
    root = Path(tmp_path_factory.mktemp("corpus"))
    made = {"sf": SF}
    for name in ("dirty", "empty"):
        folder = root / name
        folder.mkdir()
        made[name] = str(folder)
        rows = _documents() if name == "dirty" else []
        with duckdb.connect() as db:
            db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT, k INT, t VARCHAR, shard INT, score DOUBLE, x BIGINT, h VARCHAR, part INT)")
            for r in rows:
                db.execute("INSERT INTO documents VALUES (?, ?, ?, ?, NULL, 3, 'clash', 4, 0.5, 6, NULL, 8)", r)
            db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR, w INT)")
            db.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
            db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR, host VARCHAR, path INT)")
            db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT, k INT, v VARCHAR, n INT)")
            db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, key VARCHAR, layout INT, record INT)")
            if rows:
                for r in VECTORS:
                    db.execute("INSERT INTO embeddings VALUES (?, ?, 1, 2, 'clash', 3)", r)
                for r in TURNS:
                    db.execute("INSERT INTO conversations VALUES (?, ?, ?, ?, 'clash', 1, 2)", r)
                db.execute("INSERT INTO benchmark VALUES (1, ?, 0), (1, ?, 0), (2, 'Short, item!', 0), (10, ?, 0), (3, NULL, 0), (4, '', 0), (5, 'short item', 0)", [PASSAGE, PASSAGE, "zero " + PASSAGE])
                db.execute("INSERT INTO labels SELECT doc_id, doc_id % 2, 0 FROM documents WHERE doc_id > 9")
                db.execute("INSERT INTO labels VALUES (NULL, 1, 0), (12, NULL, 0)")
                for r in PAGES:
                    db.execute("INSERT INTO pages VALUES (?, ?, ?, 'clash', 1)", r)
            for table in ("documents", "benchmark", "labels", "pages", "embeddings", "conversations"):
                db.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return made


def _page(body: str) -> str:
    return f"<html><head><title>T</title><script>if (1 < 2) '<p>no</p>'</script></head><body><nav><a href=/>menu</a></nav>{body}<footer>foot</footer></body></html>"


PAGES = [
    (1, "http://h.example/1", _page("<div class='post post-1'><h1>Title &amp; more</h1><p>First   para<br>graph.<p>Second <b>one</b>.<div class=comments><p>a comment</p></div></div><div class=sidebar><p>aside text that is long enough to win by length alone if it counted at all</p></div>")),
    (2, "http://h.example/2", _page("<div class='post post-2'><p>Text of the second page.</p></div><div class=box><p>Another box on the page that holds rather more text than the post itself does here.</p></div>")),
    (3, "http://h.example/3", _page("<div class='post'><p>Text of the third page, which is long enough.</p></div>")),
    (4, "http://other.example/", "<article><p>unclosed <i>markup<p>and &lt;more&gt; &#233;</article><form><p>form</p></form>"),
    (5, None, "<p>no url</p>"),
    (6, "not a url", None),
    (7, "http://h.example/7", ""),
    (8, "http://h.example/8", "<div><<<>><p"),
    (8, "http://h.example/8", "<div><<<>><p"),
    (None, "http://h.example/9", "plain text only"),
]

#: Vectors of three and other lengths; nulls, repeats, what is not finite or not a number.
VECTORS = [
    *((i, [math.sin(i), 3 * math.cos(2 * i), 0.5 * (i % 4)]) for i in range(30)),
    (3, [math.sin(3), 3 * math.cos(6), 1.5]),  # repeated row
    (40, [math.sin(3), 3 * math.cos(6), 1.5]),
    (41, None), (42, []), (43, [1.0, None, 2.0]), (44, [1.0, math.inf, 2.0]), (45, [math.nan, 1.0, 2.0]), (46, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]),
]
TURNS = [
    (1, 0, "system", "be kind"), (1, 2, "assistant", "</s>[INST]"), (1, 1, "user", "hello\nthere"),
    (2, 0, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (2, 2, None, "no role"), (2, 2, "tool", "[TEXT]"),
    (3, None, "assistant", "early"), (3, 0, "user", "late"), (None, 0, "user", "no key"), (None, 1, "assistant", "é<\\/s>"),
    (4, 0, "user", "x" * 300_000), (4, 1, "assistant", "[" * 1000 + "</s>" * 5000), (-7, 0, "user", "taken"),
    *((5, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)),
]
