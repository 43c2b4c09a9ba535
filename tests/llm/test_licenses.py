import random
import re

from conftest import prose
from pairloom.llm import licenses


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_phrases_equal_brute_force(spark, documents, odd_rows):
    rows = odd_rows + [
        (20, "MIT License, mit-license; the Apache\nLicense. MIT"),
        (21, "license mit"),
        (22, "mit"),
        (23, "license general public license general public license"),
        (24, "émit license mit licenses"),
    ]
    got = licenses.license_labels(documents(rows)).collect()
    assert len(got) == len(rows)
    key = lambda r: repr(r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)
    assert all(0 <= r.score <= 1 for r in got)
    assert licenses.license_labels(documents([])).count() == 0


def changed(text, every):
    """Words dropped and put in along the way."""
    out = []
    for i, w in enumerate(text.split()):
        if i % every == every - 1:
            continue
        out += [w, "extra"] if i % (2 * every) == 2 else [w]
    return " ".join(out)


def test_templates_are_found_whole_and_changed(spark, documents):
    mit = dict((label, text) for label, text in licenses.TEMPLATES if len(text) > 300)["mit"]
    rows = [
        (1, f"{prose(1, 500)} {mit} {prose(2, 300)}"),
        (2, f"{prose(3, 50)} {changed(mit, 14)}"),
        (3, prose(4, 2000)),
        (4, " ".join(mit.split()[:12])),
        (5, f"{prose(5, 10)} {mit} {prose(6, 40)} {mit}"),
    ]
    spans = licenses.license_spans(documents(rows)).where("label = 'mit'").collect()
    found = {(r.doc_id, r.first_word) for r in spans}
    assert {(1, 500), (5, 10)} <= found and {d for d, _ in found} == {1, 2, 5}
    assert len([r for r in spans if r.doc_id == 5]) == 2
    labels = {r.doc_id: r for r in licenses.license_labels(documents(rows)).collect()}
    assert labels[1].labels == "mit" and labels[1].base_labels == "" and labels[1].score == 1.0
    assert labels[3].labels == "" and labels[3].score == 0.0


def test_rows_of_one_id_keep_their_own_labels(spark, documents):
    mit, gpl = (next(t for label, t in licenses.TEMPLATES if label == name and len(t) > 150) for name in ("mit", "gpl"))
    rows = [(1, mit), (1, prose(1, 60)), (1, gpl), (1, gpl), (None, mit), (None, prose(2, 40))]
    got = sorted((r.doc_id or 0, r.labels, r.score) for r in licenses.license_labels(documents(rows).repartition(4)).collect())
    # The general public license is also named by a phrase.
    assert got == [(0, "", 0.0), (0, "mit", 1.0), (1, "", 0.0), (1, "gpl", 1.0), (1, "gpl", 1.0), (1, "mit", 1.0)]


def plain_labels(text):
    """Every place of every template by comparing all word 4-grams, diagonals merged and chained in plain Python."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    grams = lambda w: [tuple(w[i : i + 4]) for i in range(len(w) - 3)]
    out = set()
    for label, template in licenses.TEMPLATES:
        wanted = grams(split(template))
        hits = sorted((at - place, at, place) for at, g in enumerate(grams(words)) for place, h in enumerate(wanted) if g == h)
        islands = []
        for hit in hits:
            if not islands or hit[0] - islands[-1][-1][0] > licenses.MAX_SHIFT:
                islands.append([])
            islands[-1].append(hit)
        for island in islands:
            ats = [at for _, at, _ in island]
            if max(ats) + 4 - min(ats) > licenses.MAX_STRETCH * (len(wanted) + 3) + licenses.MAX_SHIFT:
                continue
            best = {}
            for _, at, place in sorted(island, key=lambda h: (h[1], h[2])):
                best[at, place] = 1 + max((n for (a, p), n in best.items() if a < at and p < place), default=0)
            if max(best.values()) >= licenses.MIN_COVER * len(wanted):
                out.add(label)
    return out


def test_labels_equal_plain_python(spark, documents):
    rng, rows = random.Random(3), []
    for number, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        shuffled = words[:]
        rng.shuffle(shuffled)
        pieces = [words[i : i + 6] for i in range(0, len(words), 6)]
        for made in (words, shuffled, sum(reversed(pieces), []), words[: len(words) // 2], changed(text, 9).split(), changed(text, 5).split()):
            rows.append((len(rows), f"{prose(number, 30)} {' '.join(made)} {prose(number + 50, 30)}"))
    got = {r.doc_id: r for r in licenses.license_labels(documents(rows)).collect()}
    for doc_id, text in rows:
        base = set(filter(None, brute(text)[4].split(",")))
        assert set(filter(None, got[doc_id].labels.split(","))) == base | plain_labels(text), text
    assert len({r.labels for r in got.values()}) > 5


def test_places_out_of_order_are_no_chain():
    assert licenses.longest_chain([(i, i) for i in range(9)]) == 9
    assert licenses.longest_chain([(i, 9 - i) for i in range(9)]) == 1
    assert licenses.longest_chain([(1, 5), (1, 6), (2, 5), (3, 7)]) == 2
