from pairloom.llm import frames, urls

ROWS = [
    (0, "HTTP://Www.Example.ORG/es/1?x#y", "allow-nothing", "www.example.org", "/es/1", "example.org/es/", "block"),
    (1, "https://example.org/en/12", "", "example.org", "/en/12", "example.org/en/1", "block"),
    (2, "https://example.org/en/2", None, "example.org", "/en/2", "org/", "allow"),
    (3, "https://notexample.org/es/", "", "notexample.org", "/es/", "org/", "allow"),
    (4, "http://a.b.com/fr/?q=/de/", "", "a.b.com", "/fr/", "com/fr/", "allow"),
    (5, "http://com/de/x", "", "com", "/de/x", "com/de/", "block"),
    (6, "http://telecom/de/x", "", "telecom", "/de/x", None, None),
    (7, "http://x.org", "", "x.org", "", None, None),
    (8, "http://x.org?/", "", "x.org", "", None, None),
    (9, "no-scheme.org/es/", "", "", "", None, "allow"),
    (10, None, None, "", "", None, "allow"),
    (11, "", "", "", "", None, "allow"),
    (12, "ÄÖ://ÄÖ.com/De/#://", "", "ÄÖ.com", "/De/", None, None),
    (13, "a://b://c.org/", "", "b:", "//c.org/", None, None),
    (13, "a://b://c.org/", "", "b:", "//c.org/", None, None),
    (None, "http://x.org/", "", "x.org", "/", "org/", "allow"),
    (14, "http://" + "w" * 3000 + ".net/", "", "w" * 3000 + ".net", "/", None, None),
]


def pages(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], "h", "p", "r") for r in rows], "page_id long, url string, html string, host string, path string, rule string")


def test_parts_rules_and_verdicts(spark):
    got = urls.url_verdicts(pages(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    key = lambda r: (repr(r[0]), r[1])
    for g, w in zip(sorted((tuple(g) for g in got), key=key), sorted(((r[0], r[3], r[4], r[5], r[6]) for r in ROWS), key=key)):
        assert g[:4] == w[:4]
        assert g[4] == w[4] if w[4] else g[4] in ("allow", "block")
        assert 0 <= g[5] <= 1
    assert urls.url_verdicts(pages(spark, [])).count() == 0


def brute_split(counts, name):
    model = urls.Segmenter(counts)
    if not name:
        return 0.0, ()
    options = []
    for mask in range(1 << (len(name) - 1)):
        words, at = [], 0
        for i in range(1, len(name) + 1):
            if i == len(name) or mask >> (i - 1) & 1:
                words.append(name[at:i])
                at = i
        options.append((sum(model.cost.get(w, model._unknown(len(w))) for w in words), tuple(words)))
    return min(options)


def test_viterbi_equals_all_splits():
    counts = {"cheap": 50, "pills": 40, "pill": 60, "s": 3, "online": 300, "on": 300, "line": 80, "che": 2, "ap": 5}
    model = urls.Segmenter(counts)
    for name in ("cheappills", "pillsonline", "onlinepill", "zzon", "p", ""):
        cost, words = brute_split(counts, name)
        got = model.split(name)
        assert "".join(got) == name
        assert abs(sum(model.cost.get(w, model._unknown(len(w))) for w in got) - cost) < 1e-9
    assert model.split("cheappillsonline") == ("cheap", "pills", "online")


def test_bayes_learns_from_rules_and_seeds(spark):
    rows = [(i, f"http://site{i}.com/{'de' if i % 2 else 'fr'}/{'grumwort' if i % 2 else 'baldo'}", "cheap pills cheap pills cheap pills " * 3) for i in range(80)]
    rows += [(100, "http://x.net/grumwort", ""), (101, "http://x.net/baldo", ""), (102, "http://cheappills.net/", "")]
    got = {r.page_id: r.verdict for r in urls.url_verdicts(pages(spark, rows)).collect()}
    assert got[100] == "block" and got[101] == "allow" and got[102] == "block"


def test_the_size_of_the_head_changes_nothing(spark, monkeypatch):
    """Rare words and tokens count as they would in the head."""
    rows = [(i, f"http://site{i}.com/{'de' if i % 2 else 'fr'}/{'grumwort' if i % 2 else 'baldo'}", "cheap pills grum wort " * (3 if i < 3 else 1)) for i in range(80)]
    rows += [(80, "http://a.com/de/zwickel-zwickel", "zwickel zwickel zwickel"), (100, "http://x.net/grumwort", ""), (101, "http://x.net/baldo", "")]
    rows += [(102, "http://cheappills.net/", ""), (103, "http://zwickelbaldo.net/zwickel", ""), (104, "http://casino.net/wort", ""), (105, None, None)]
    got = lambda: sorted((r.page_id, r.verdict, round(r.block_probability, 9)) for r in urls.url_verdicts(pages(spark, rows)).collect())
    whole = got()
    for most in (0, 2, 5):
        monkeypatch.setattr(urls, "most_frequent", lambda rows, count_col, keep, most=most: frames.most_frequent(rows, count_col, most))
        assert got() == whole
