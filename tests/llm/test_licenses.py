"""Every template finds its own text, whatever its lines and sentences."""

from __future__ import annotations

import textwrap

from txnwatch.llm import licenses


def test_every_template_finds_its_own_text(spark):
    table, want = [], {}
    for label, text in licenses.TEMPLATES:
        plain = f"Some words stand before it. {text} Then others follow."
        forms = [text, plain, *(textwrap.fill(f"Words before it and {text} others behind", width, break_long_words=False) for width in (12, 30, 72)),
                 " * " + textwrap.fill(plain, 34).replace("\n", "\r\n * "), "\n".join(text.split())]
        for form in forms:
            want[len(table)] = label
            table.append((len(table), form))
    own = len(table)
    far = licenses.TEMPLATES[1][1].split()
    table += [(own, "rights. All. reserved"), (own + 1, "All of it.\nThe rights are theirs.\nSeats are reserved."),
              (own + 2, "\n".join(w + " and many other words besides that come in between" for w in far))]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert [i for i, label in want.items() if label not in found[i]["labels"].split(",") or found[i]["score"] < licenses.THRESHOLD] == []
    assert [found[own + i]["labels"] for i in range(3)] == ["", "", ""]
