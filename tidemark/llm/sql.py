"""SQL of the text operators: the look of a text and its words as expressions, built from the same fixed values."""

from __future__ import annotations

import unicodedata

from tidemark.llm import lookalike

#: Blocks whose letters may look Latin.
_BLOCKS = (*range(0x370, 0x530), *range(0x1F00, 0x2000))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translated(x: str, table: dict[int, str]) -> str:
    """``x`` with letters replaced by ``table``, composed ones by their replaced base and its marks, then composed anew."""
    for ch in map(chr, _BLOCKS):
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and ord(parts[0]) in table:
            x = f"replace({x}, {_quoted(ch)}, {_quoted(parts.translate(table))})"
    single = {c: v for c, v in table.items() if len(v) == 1}
    return f"nfc_normalize(translate({x}, {_quoted(''.join(map(chr, single)))}, {_quoted(''.join(single.values()))}))"


def look(x: str) -> str:
    """Equal for texts that look alike."""
    bare = f"regexp_replace({x}, {_quoted('[' + lookalike.IGNORABLE + ']+')}, '', 'g')"
    forms = lookalike._COMPAT_MAP
    plain = f"nfc_normalize(translate({bare}, {_quoted(''.join(map(chr, forms)))}, {_quoted(''.join(map(chr, forms.values())))}))"
    return _translated(plain, lookalike._SKELETON)


def words(x: str) -> str:
    """The list of words, equal without regard to case, of a text given by its look."""
    lower = f"replace(lower({x}), 'ß', 'ss')"
    return rf"regexp_extract_all({_translated(lower, lookalike._FOLD_AFTER)}, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\x{{300}}-\x{{36f}}]*')"


_LOOKS = f"u as (select doc_id, text, {look('text')} as k from documents where text is not null)"
_LEAKS = f"""
with d as (select doc_id, {words("k")} as w from (select doc_id, {look("text")} as k from documents where text is not null)),
i as (select item_id, {words("k")} as w from (select item_id, {look("text")} as k from eval_items where text is not null)),
dg as (select doc_id, array_to_string(w[n : n + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as n from d where len(w) >= 12)),
ig as (select item_id, array_to_string(w[n : n + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as n from i where len(w) >= 12)),
p as (select distinct item_id, doc_id from ig join dg using (g))
"""

ORACLE = {
    "p8_found": _LEAKS + "select item_id, doc_id from p",
    "p8_items": _LEAKS + "select item_id, task, split, coalesce(n, 0) as pages from eval_items left join (select item_id, count(*) as n from p group by item_id) using (item_id)",
    "p10_found": f"with {_LOOKS} select a.doc_id as doc_id_a, b.doc_id as doc_id_b from u a join u b on a.k = b.k and a.doc_id < b.doc_id and a.text <> b.text",
    "p10_classes": f"""with {_LOOKS}, t as (select k, text, count(*) as n from u group by k, text), c as (select k, min(doc_id) as class_id, count(*) as n, count(distinct text) as texts from u group by k)
select doc_id, class_id, c.n - t.n as links from u join t using (k, text) join c using (k) where texts > 1""",
}
