"""Leaks whose names, case, line breaks or extent differ from the item."""

from __future__ import annotations

import random
import re
from collections import Counter

from txnwatch.llm import decontaminate

STORY = ("Natalia sold clips to her friends. Natalia then sold half as many in May. Natalia gave the rest away. "
         "Natalia wants to know the total. Natalia asks Tom how many clips were sold altogether in April and May?")
PLAIN = " ".join(f"{a}{b}" for a in ("ra", "to", "mi", "ne", "shu", "kel") for b in ("va", "lo", "pe", "di", "sa", "gu", "ro", "fi", "na", "be"))


def test_leaks_in_other_dress(spark):
    items = spark.createDataFrame([(1, STORY), (2, PLAIN)], "item_id long, text string")
    table = [(1, STORY), (2, STORY.replace("Natalia", "Weng")), (3, STORY.lower()), (4, STORY.upper()), (5, STORY.replace(" ", "\n")),
             (6, STORY.replace("Natalia", "Weng").replace(" Weng", "\nWeng").replace(" Tom", "\n\nTom")), (7, '"' + STORY.replace("Natalia", "Élodie’s") + '"'),
             (8, "before it " + " ".join(PLAIN.split()[20:49]) + " behind it"), (9, " ".join(PLAIN.split()[20:32])), (10, " ".join(reversed(PLAIN.split()))),
             (11, STORY.replace("Natalia", "Weng", 1).replace("Natalia", "Eva", 1).lower()[:40])]
    found = {(r["id"], r["item_id"]): r for r in decontaminate.leaks(spark.createDataFrame(table, "doc_id long, text string"), items).select("doc.id", "*").collect()}
    assert set(found) == {(i, 1) for i in range(1, 8)} | {(8, 2)}
    assert all(found[i, 1]["coverage"] == 1 for i in (1, 3, 4, 5)) and found[8, 2]["windows"] == 22 and found[8, 2]["coverage"] < 0.5
    assert found[2, 1]["coverage"] >= 0.9 and found[2, 1]["reparameterised"] and not found[3, 1]["reparameterised"]


def test_slots_must_agree_over_all_windows(spark):
    """One name of the item for one of the document: told apart from a copy with three names, wherever their windows end."""
    items = spark.createDataFrame([(1, STORY)], "item_id long, text string")
    mixed = STORY
    for name in ("Weng", "Eva", "Ada", "Tim", "Ned"):
        mixed = mixed.replace("Natalia", name, 1)
    table = [(1, STORY), (2, STORY.replace("Natalia", "Weng")), (3, mixed), (4, STORY.replace("Natalia", "Weng", 2)), (5, STORY.replace("Natalia", "Tom"))]
    found = {r["id"]: r for r in decontaminate.leaks(spark.createDataFrame(table, "doc_id long, text string"), items, run=99, coverage=0.0).select("doc.id", "*").collect()}
    assert found[1]["consistent"] and not found[1]["reparameterised"] and found[1]["coverage"] == 1
    assert found[2]["consistent"] and found[2]["reparameterised"] and found[2]["coverage"] == 1
    assert not found[3]["consistent"] and found[3]["windows"] < found[2]["windows"]
    assert not found[4]["consistent"] and found[3]["windows"] < found[4]["windows"] < found[2]["windows"]
    # two names of the item for one of the document
    assert not found[5]["consistent"] and found[5]["windows"] < found[2]["windows"]


def test_leaks_equal_brute_force(spark):
    """Every window of every item against every place of every document, with slots folded in plain Python."""
    rng = random.Random(5)
    names, words = ["Ana", "Bo", "Cy", "Dee"], ["buys", "red", "green", "apples", "then", "sells", "some", "of", "them", "to", "a", "friend", "for", "the", "price", "paid"]

    def sentence():
        return " ".join(rng.choice([rng.choice(words), rng.choice(words), rng.choice(words), rng.choice(names), str(rng.randrange(9)), f"{rng.randrange(30)} km"]) for _ in range(rng.randint(6, 16)))
    items = [(i, sentence()) for i in range(30)] + [(40, None), (41, ""), (3, "Ana buys 3 red apples")]
    docs = []
    for i in range(120):
        _, base = items[rng.randrange(30)]
        swap = dict(zip(names, rng.sample(names, 4), strict=True)) if rng.random() < 0.5 else {}
        text = " ".join(swap.get(w, str((int(w) * 3 + 1) % 10) if w.isdigit() and rng.random() < 0.3 else w) for w in base.split())
        docs.append((i, rng.choice([f"{sentence()} {text} {sentence()}", text, text.lower(), sentence(), text.replace(" ", "\n"), " ".join(text.split()[:7])])))
    docs += [(200, None), (201, ""), (5, docs[5][1])]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r["id"], r["item_id"], r["windows"], r["of"], r["first_word"], r["last_word"], r["reparameterised"], r["consistent"]) for r in found.select("doc.id", "*").collect())
    want = Counter(brute_leaks(docs, items))
    assert got == want, ([(k, dict(docs)[k[0]], dict(items)[k[1]]) for k in (got - want)], [(k, dict(docs)[k[0]], dict(items)[k[1]]) for k in (want - got)])
    assert len(got) > 20 and len({k[-1] for k in got}) == 2


def canonical(text: str, named: bool):
    """(mark or word, value) per canonical word."""
    out = []
    for token in re.findall(r"[0-9][0-9.,:/]*|[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""):
        if token[0].isdigit():
            out.append(("#", token.rstrip(".,:/").lower()))
        elif token.lower() in decontaminate.UNITS and out and out[-1][0] == "#":
            out.append(("%", token.lower()))
        elif named and token[0].isupper() and len(token) > 1:
            out.append(("@", token.lower()))
        else:
            out.append((token.lower(), None))
    return out


def brute_leaks(docs, items, window=8, coverage=0.5, run=6):
    for doc, text in dict.fromkeys(docs):
        for item, item_text in dict.fromkeys(items):
            matches, of = [], set()
            for named in (True, False):
                own, them = canonical(text, named), canonical(item_text, named)
                n = min(window, len(them))
                for i in range(len(them) - n + 1 if n else 0):
                    part = them[i:i + n]
                    if (named and not any(m == "@" for m, _ in part)) or all(m in "#@%" for m, _ in part):
                        continue
                    of.add(i)
                    for k in range(len(own) - n + 1):
                        other = own[k:k + n]
                        if [m for m, _ in part] != [m for m, _ in other]:
                            continue
                        pairs = {((m, b), (m, a)) for (m, a), (_, b) in zip(part, other, strict=True) if m in "#@%"}
                        if len({d for d, _ in pairs}) == len(pairs) == len({s for _, s in pairs}):
                            matches.append((i, k, n, pairs))
            votes = Counter(p for *_, pairs in matches for p in pairs)
            # marks sort as the placeholders do: numbers, names, units
            place = {"#": 0, "@": 1, "%": 2}

            def rank(x):
                return place[x[0]], x[1]
            best = {(d, s) for d, s in votes if (d, s) == min(((e, s) for e, t in votes if t == s), key=lambda p: (-votes[p], rank(p[0])))
                    and (d, s) == min(((d, t) for e, t in votes if e == d), key=lambda p: (-votes[p], rank(p[1])))}
            kept = [m for m in matches if m[3] <= best]
            if not kept:
                continue
            lines, longest = {(k - i, i) for i, k, *_ in kept}, 0
            for shift, i in lines:
                n = 0
                while (shift, i + n) in lines:
                    n += 1
                longest = max(longest, n)
            held = {i for i, *_ in kept}
            if len(held) / len(of) >= coverage or longest >= run:
                yield (doc, item, len(held), len(of), min(k for _, k, *_ in kept), max(k + n - 1 for _, k, n, _ in kept),
                       any(a != b for *_, pairs in kept for a, b in pairs), set(votes) <= best)
