from itertools import groupby

import numpy as np
import pytest

from tidewright.llm import chat
from tidewright.llm.html_text import main_text

PROSE = "The boats went out before it was light and came back with all that the nets could hold, and the whole town stood on the quay to see them."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<nav><ul><li><a href=/a>A b</a></li></ul></nav><article><h1>News</h1><p><b>{PROSE}<br><p>To.</p></article><footer>&copy; x.org</footer>", f"News\n{PROSE}\nTo."),
        (f"<body><script>var t='</p>';</script><style>p{{}}</style><p>{PROSE}</p><p>A &amp; B &lt;c&gt; {PROSE}\n\t x</p></body>", f"{PROSE}\nA & B <c> {PROSE} x"),
        (f"<header>Site name</header><main><p>{PROSE}</p><aside>See also this and that</aside></main><div class='cookie-notice'>We use cookies on this site to make it better for you.</div>", PROSE),
        (f"<article><p>{PROSE}</p></article><section id=comments><p>{PROSE} I think so too.</p></section>", PROSE),
        (f"<article><p>{PROSE}</p><form><label>Mail</label><input><p>Send us a letter</p></form><p>Fin</p></article>", f"{PROSE}\nFin"),
        (f"<!-- <p>x</p> --><article><p>{PROSE} <a href='x'>linked words</a> end.<li>one<li>two</ul></article>", f"{PROSE} linked words end.\none\ntwo"),
        ("<article><p>" + "y" * 200_000 + "</p></article>", "y" * 200_000),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_extract(spark):
    from tidewright.llm.html_text import extract

    pages = spark.createDataFrame([(1, "u", f"<article><p>{PROSE}</p></article>", 5), (2, None, None, 6), (1, "u", f"<article><p>{PROSE}</p></article>", 5)], "page_id long, url string, html string, text long")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract(pages).collect()) == [(1, PROSE, len(PROSE)), (1, PROSE, len(PROSE)), (2, "", 0)]
    assert extract(pages.limit(0)).count() == 0


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    low = lambda v: (v is not None, v if v is not None else "")
    convs = {c: sorted({r[1:4] for r in g}, key=lambda t: (low(t[0]) if t[0] is not None else (False, 0), low(t[1]), low(t[2]))) for c, g in groupby(sorted(rows, key=key), key=lambda r: r[0])}
    bare = {c: tuple(t[1:] for t in ts) for c, ts in convs.items()}
    longer = {v[:k] for v in bare.values() for k in range(1, len(v))}
    out, seen = {}, {}
    for c, v in sorted(bare.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        if v not in longer:
            first = seen.setdefault(v, c)
            out.setdefault(first, [len(v), 0, "".join(f"<|{(r or '').replace('<|', '< |').strip().lower() or 'unknown'}|>\n{(t or '').replace('<|', '< |')}\n<|end|>\n" for r, t in v)])[1] += 1
    return {c: tuple(v) for c, v in out.items()}


def test_collapse_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for c in range(120):
        n = int(rng.integers(1, 6))
        base = int(rng.integers(0, 8))
        start = int(rng.integers(0, 3))
        for t in range(n):
            rows.append((c, start + 2 * t, "user" if t % 2 == 0 else "Assistant", f"t{base}-{t}-{int(rng.random() < 0.1)}", None))
    rows += [(200, 0, None, "a", None), (200, 1, "user", None, None), (201, 0, None, "a", None), (202, 0, "", "a", None), (203, None, "user", "<|end|>", None), (203, 1, "user", "", None), (204, 0, "user", "z", None), (204, 0, "user", "z", None), (None, 0, "user", "lone", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["rendered"]) for r in chat.collapse(frame).collect()}
    assert got == brute(rows)
    assert chat.collapse(frame.limit(0)).count() == 0
    assert not any("Python" in x or "Arrow" in x for x in chat.collapse(frame)._jdf.queryExecution().executedPlan().toString().split())
