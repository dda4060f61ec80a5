"""Pages that would take long or grow: time and text stay in proportion to the page."""

import random
import time

import pytest

pytest.importorskip("bandscope.llm")

from bandscope.llm import html_text  # noqa: E402

MB = 1_000_000
HOSTILE = {
    "unclosed tags": "<a " * (MB // 3),
    "unclosed names": "<a'" * (MB // 3),
    "unclosed values": '<a "' * (MB // 4),
    "mixed quotes": "<a \"'" * (MB // 5),
    "unclosed end tags": "</a " * (MB // 4),
    "signs": "<" * MB,
    "one long cell": "<table><tr><td>" + "w " * (MB // 10) + "</td><td>b</td></tr>" + "<tr><td>a</td><td>b</td></tr>" * 10_000 + "</table>",
    "one long row": "<table><tr>" + "<td>a</td>" * 10_000 + "</tr>" + "<tr><td>a</td><td>b</td></tr>" * 10_000 + "</table>",
    "cells of many lines": "<table><tr>" + "<td>a</td>" * 5_000 + "<td>" + "b<br>" * 50_000 + "</td></tr></table>",
    "skipped columns": "<table>" + "<tr><td colspan=1000>a<td>b" * 20_000 + "</table>",
    "columns from above": "<table><tr>" + "<td rowspan=65534>a" * 10_000 + "</tr>" + "<tr><td>a" * 10_000 + "</table>",
    "deep lists": "<ul><li>" * 500 + "<li>a" * 50_000,
    "columns before tables": "<table><tr><td>a<td>" * 50 + "b<br>" * 50_000,
    "lists around tables": "<ul><li><table><tr><td>" * 50 + "b<br>" * 50_000,
    "deep rows": "<table>" + "<div>" * 500 + "<i></i>" * 50_000 + "<td>x",
    "strings in rules": "<style>" + '"\\' * (MB // 2) + "</style>x",
    "nested rules": "<style>" + "a{" * (MB // 10) + "}" * (MB // 10) + "</style>x",
}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_time_and_text_follow_the_page(name):
    page = HOSTILE[name]
    t = time.process_time()
    text, _ = html_text.text_of(page)
    assert time.process_time() - t < 10
    assert len(text) < 12 * len(page)


def test_tags_of_broken_markup_by_brute_force():
    """A start is a tag if a ``>`` outside quotes follows its name; every start is tried anew here."""

    def tags(source):
        out, at = [], 0
        while at < len(source):
            if source[at] != "<":
                at += 1
                continue
            if source[at + 1 : at + 2] in ("!", "?"):
                comment = source.startswith("<!--", at)
                end = source.find("-->" if comment else ">", at + (4 if comment else 2))
                end = len(source) if end < 0 else end + (3 if comment else 1)
                out.append((at, end))
                at = end
                continue
            start = at + 1 + source.startswith("/", at + 1)
            i, quote = start, None
            if not source[start : start + 1].isalpha():
                at += 1
                continue
            while i < len(source) and source[i] not in " />":
                i += 1
            while i < len(source) and (quote or source[i] != ">"):
                quote = None if source[i] == quote else quote or (source[i] if source[i] in "\"'" else None)
                i += 1
            if i < len(source):
                out.append((at, i + 1))
            at = i + 1 if i < len(source) else at + 1
        return out

    rng = random.Random(5)
    for _ in range(5_000):
        source = "".join(rng.choice(["<a ", "<b", "</", "<!--", "-->", "<?", "'", '"', ">", " ", "x", "<", "/"]) for _ in range(rng.randint(1, 25)))
        scanner, at, got = html_text.Tags(source), 0, []
        while (found := scanner.after(at)) is not None:
            got.append(found[:2])
            at = found[1]
        assert got == tags(source), source


def test_a_long_line_leaves_the_other_rows_aligned():
    page = f"<table><tr><td>a</td><td>b</td></tr><tr><td>{'x' * 150}</td><td>c</td></tr><tr><td>aaa</td><td>d</td></tr></table>"
    assert html_text.text_of(page)[0].split("\n") == ["a   | b", "x" * 150 + " | c", "aaa | d"]
