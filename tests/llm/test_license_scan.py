import random
import re

from fleetlens.llm import license_scan

PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(n, label) for label, p in PHRASES.items() for n in range(len(words))
              if words[n : n + len(p.split())] == p.split()]
    starts = [n for n, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


def test_tricky_documents(tricky_docs, tricky):
    rows = license_scan.license_scan(tricky_docs).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t, _ in tricky), key=repr)
    for r in rows:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_phrases_at_the_ends_and_overlapping(spark):
    texts = [
        "all rights reserved", "x all rights reserved", "all rights all rights reserved reserved",
        "cc by cc by cc", "cc  by\n-cc--by", "general public public license", "rights reserved all",
        "the MIT license", "Released under the MIT License.", "licensed under CC BY-NC 4.0",
        "GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "cc" * 50 + " by",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
    assert [rows[i]["labels"] for i in (7, 8, 9, 10, 11)] == ["mit", "mit", "cc-by,cc-by-nc", "gpl,gpl-3.0", "apache-2.0"]
    assert rows[8]["score"] == 1 and rows[12]["score"] == 0


def by_rule(texts, templates=license_scan.TEMPLATES, agree=0.5):
    """Labels and score of each text, place by place: rare words that agree, then the key phrase word for word."""
    cut = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    known = {w for t in templates for w in t.words.split()}
    often = {w: sum(w in set(words) for words in cut) for w in known}
    rarity = {w: (max(often.values()) + 1) / (often[w] + 1) for w in known}
    out = []
    for words in cut:
        labels, score = set(), 0.0
        for t in templates:
            all_, key = t.words.split(), t.key.split()
            at = next(i for i in range(len(all_)) if all_[i : i + len(key)] == key)
            rarest = lambda places: sorted(places, key=lambda i: (-rarity[all_[i]], i))[: -(-len(places) // 2)]
            indexed = set(rarest(range(at, at + len(key)))) | (set() if t.base else set(rarest(range(len(all_)))))
            need = max(1, min(sum(at <= i < at + len(key) for i in indexed), -(-int(agree * len(indexed) * 100) // 100)))
            for begin in range(-len(all_), len(words) + 1):
                there = [i for i in indexed if 0 <= begin + i < len(words) and words[begin + i] == all_[i]]
                if len(there) < need or begin + at < 0 or words[begin + at : begin + at + len(key)] != key:
                    continue
                labels.add(t.label)
                share = sum(rarity[all_[i]] for i in there) / sum(rarity[w] for w in all_)
                score = max(score, 1.0 if len(there) == len(indexed) else share)
        out.append((",".join(sorted(labels)), round(score, 9)))
    return out


def test_labels_and_scores_against_the_rule(spark, tricky):
    """Whole notices, cut and mixed ones, and texts of template words in any order."""
    draw = random.Random(4)
    known = sorted({w for t in license_scan.TEMPLATES for w in t.words.split()})
    texts = [t for _, t, _ in tricky] + ["all rights waived", "rights reserved", "permission is hereby granted free of"]
    for t in license_scan.TEMPLATES:
        words = t.words.split()
        texts += [t.words, f"{t.key} by x", " ".join(words[1:]), " ".join(words[:-1]), " ".join(["y", *words, *words])]
    texts += [" ".join(draw.choice(known) for _ in range(60)) for _ in range(60)]
    texts.append(" ".join(["gnu general public license version"] * 400))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan.license_scan(docs).collect()}
    want = by_rule(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert got[len(tricky)] == ("", 0.0) and got[len(tricky) + 1] == ("", 0.0)


def test_no_documents(no_docs):
    assert license_scan.license_scan(no_docs).collect() == []


def test_no_python_on_the_executors(tricky_docs):
    plan = license_scan.license_scan(tricky_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
