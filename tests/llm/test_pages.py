import itertools
import random
import re
import time

import pytest
from test_llm import prose

from linguaspan.llm import host_suffixes, repeats


@pytest.mark.parametrize("shard_bytes", [1 << 23, 3000])
def test_page_texts_equal_brute_force(spark, shard_bytes, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(host_suffixes, "HOST_BYTES", shard_bytes)  # hosts of more are split
    rng = random.Random(14)
    blocks = [f"<div class=x><p>{prose(rng, rng.randint(3, 25))}</p></div>" for _ in range(12)]
    rows = []
    for i in range(60):
        inner = "".join(rng.choice(blocks) if rng.random() < 0.6 else f"<p>{prose(rng, rng.randint(1, 30))}</p>" for _ in range(rng.randint(0, 8)))
        rows.append((i, f"http://h{i % 3 if i % 2 else 0}.org/{i}", f"<body>{inner}</body>", "clash"))
    rows += [(60, "http://h0.org/copy", rows[2][2], "clash"), (61, "http://H0.org:80/", "<body>" + blocks[0] * 400 + prose(rng, 20000) + "</body>", "clash"), (62, None, rows[0][2], ""), (63, None, rows[0][2] + " x", ""), (62, None, rows[0][2], "")]
    split = {n: [(t or "<" + g, not t) for g, t in re.findall(r"<(/?[a-z0-9]+)[^>]*>|([^\s<]+)", h)] for n, (_, _, h, _) in enumerate(rows)}
    name = {n: host_suffixes.host(u) for n, (_, u, _, _) in enumerate(rows)}
    seen = {}
    for n, tokens in split.items():
        for s in range(len(tokens) - 15):
            seen.setdefault((name[n], tuple(tokens[s : s + 16])), set()).add(tuple(tokens))
    want = []
    for n, tokens in split.items():
        covered = set()
        for s in range(len(tokens) - 15):
            if len(seen[name[n], tuple(tokens[s : s + 16])]) > 1:
                covered |= set(range(s, s + 16))
        runs = itertools.groupby([(w, p in covered) for p, (w, tag) in enumerate(tokens) if not tag], key=lambda x: x[1])
        want.append((rows[n][0], [w for gone, run in runs for words in [[w for w, _ in run]] if not gone and len(words) >= 5 for w in words]))
    got = host_suffixes.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, HTML string"), 16, 5).collect()
    assert sorted((r.page_id, r.text.split()) for r in got) == sorted(want)


def test_what_pages_hide_is_found_in_one_pass():
    hidden, rng = re.compile(rb"(?is)<(script|style|noscript|template|title)\b[^>]*>.*?</\1\s*>|<!--.*?-->"), random.Random(1)
    bits = [b"<script>", b"</script>", b"<style a>", b"</style >", b"<!--", b"-->", b"x", b"<scripts>", b"<SCRIPT", b">", b"</Script>", b"<title>", b"</title>", b" "]
    for _ in range(2000):
        page = b"".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert host_suffixes.visible(page) == hidden.sub(b" ", page)
    for bad in (b"<script>x", b"<!--", b"<script", b"<title>-->"):
        start = time.time()
        host_suffixes.visible(bad * 8000)
        assert time.time() - start < 1
