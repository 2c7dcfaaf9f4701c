"""Template residue and error pages in place of content (problem 10).

Records made from one template are aligned over the whole corpus, and only what is aligned with other records decides.

* Lines of a message are cut into fixed parts and slots; lines of the same fixed parts give the values of one position,
  and where these vary, the position is a slot. A name within delimiters that is left in it is flagged. A name counts as
  a variable's name wherever it stands as a slot if it was left under several kinds of delimiters and in several
  records, or at several such positions.
* Messages that are forms (labels with values) are aligned by their sequence of labels. A value that several records of
  different content keep, at a position that varies, is the template's default. A form all of whose slots are blank or
  hold defaults is flagged if its sequence of labels is that of several records of different content.
* Patterns of instructions, filler, tools' messages and notices about scripts only propose a line. It is flagged if its
  skeleton (numbers and hashes masked) stands in several records of different content; prose that merely speaks of such
  things stands in one.
* Pages without a diff: HTML pages of one skeleton over all their lines give the titles that fill its slot, and plain
  pages that open with such a title are flagged. A page that opens with an error's title is proposed, and flagged if the
  title recurs and each of its further lines is aligned, up to one varying word, with lines of other such pages.

What a diff shows never counts, nor does a name in the middle of a sentence, nor a blank slot beside filled ones.

Null and edge cases: null, empty and blank texts are no cases. Line ends of any kind and a byte order mark are
ignored. A repeated row or a doc_id with several texts comes out once if any of its texts is a case. Copies of one
commit count as one record. Whole texts are read, however long. Extra columns are ignored; an empty table gives an
empty result. A template that the corpus shows fewer than `least_records` times is not told from content.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from carex.session import materialise

# Words of the usual filler text.
FILLER_WORDS = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
    aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis
    aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat
    non proident sunt culpa qui officia deserunt mollit anim id est laborum""".split()
)
# Reason phrases of HTTP statuses and what servers put in their place.
REASONS = (
    r"bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|"
    r"request time-?out|conflict|gone|too many requests|internal server error|not implemented|bad gateway|"
    r"service (?:temporarily )?unavailable|gateway time-?out|access denied|page not found"
)
TITLE = re.compile(
    rf"(?:http(?:/[\d.]+)?\s+|error:?\s+|erreur\s+|fehler\s+|status\s+)?[45]\d\d\b\s*[:.–-]?\s*(?:{REASONS})\.?"
    rf"|(?:{REASONS})"
    r"|(?:error|erreur|fehler)\s+[45]\d\d\b.{0,60}"
    r"|(?:your|the) session (?:has )?expired\.?|something went wrong(?: on our side)?\.?"
    r"|(?:this |the )?(?:repository|commit|page|diff|service|site|server)(?: is| could not be| was not)? "
    r"(?:currently |temporarily )?(?:unavailable|not available|found|not found)\.?"
    r"|página no encontrada|page introuvable|seite nicht gefunden|accès refusé|zugriff verweigert|acceso denegado"
    r"|ページが見つかりません|アクセスが拒否されました|页面未找到|找不到页面",
    re.I,
)
SCRIPTS = re.compile(
    r"(?:please |you (?:need|have|must) to |bitte )?(?:enable|activate|turn on|allow|switch on)(?: your)? (?:javascript|scripts?)\b"
    r"|(?:javascript|scripts?) (?:is|are) (?:disabled|turned off|not enabled|required)"
    r"|(?:requires?|needs?) (?:javascript|scripts)\b|without javascript enabled"
    r"|(?:veuillez )?activ(?:er|ez|e|a|ar) javascript|(?:benötigt|erfordert) javascript|javascript.{0,40}aktivieren"
    r"|javascriptを有効|(?:请)?(?:启用|开启) ?javascript|(?:habilite|active|ative) (?:o )?javascript",
    re.I,
)
TOOL = re.compile(
    r"fatal: (?:bad object|not a git repository|unable to|could not|repository|remote).*"
    r"|abort: (?:unknown revision|error|repository|http).*|svn: e\d+: .*"
    r"|error: (?:could not|unable to|cannot) (?:read|fetch|load|access|connect|find|open|get)\b.*"
    r"|[\[(]?(?:error: )?(?:the )?(?:diff|patch|commit|content)s? (?:is|was|are|could not be|cannot be|not) "
    r"(?:temporarily )?(?:un)?(?:available|loaded|shown|fetched|displayed|found|rendered)\b.*",
    re.I,
)
ERROR_OBJECT = re.compile(r'\{.*"(?:error|message|reason|detail)"\s*:.*"?(?:status|code|error|statusCode)"?\s*:\s*"?[45]\d\d\b.*\}\s*', re.I | re.S)
INSTRUCTION = re.compile(
    r"todo:? (?:write|fill|add|describe|insert|complete)\b(?: (?:a|the|your|this|me|in|out))*(?: (?:summary|description|title|message|body|details?|here))?\.?"
    r"|[(\[<]?(?:describe|explain|insert|enter|write|type|add|put|fill in|replace)(?: (?:a|the|your|this|it|text|title|summary|description|message|details?|issue|change|changes|short|here))+(?: in detail)?(?:\.{1,3}|…)?[)\]>]?"
    r"|type a (?:short )?(?:title|summary) above this line|explain the problem that this (?:commit|change) is solving"
    r"|<!--.*(?:describe|explain|link|insert|add|list|delete|replace|remove|fill|enter|what|why)\b.*-->"
    r"|(?:\w+ ){0,4}goes here\.?|sample text goes here.*|.*replace this text(?: before .*)?"
    r"|(?:this is (?:a )?placeholder(?: text)?[. ]*)+|platzhalter(?:text)?\b.*|(?:bitte )?(?:titel|text|beschreibung) (?:eingeben|einfügen|ersetzen)\.?"
    r"|(?:texte? (?:fictif|de remplacement)|texto de (?:relleno|ejemplo|marcador)|ダミーテキスト|占位(?:符|文本)).*",
    re.I,
)
REPEATED = re.compile(r"(\w+)(?:[\s.,;-]+\1){2,}[.\s]*", re.I)

_INNER = r"\s*([^\W\d_][\w .\-]*?)\s*"
STYLES = (
    ("{{}}", rf"\{{\{{{_INNER}\}}\}}"), ("${}", rf"\$\{{{_INNER}\}}"), ("$()", rf"\$\({_INNER}\)"), ("<%%>", rf"<%=?{_INNER}%>"),
    ("[[]]", rf"\[\[{_INNER}\]\]"), ("@@", rf"@@{_INNER}@@"), ("__", rf"__{_INNER}__"), ("%%", rf"%{_INNER}%"),
    ("[]", rf"\[{_INNER}\]"), ("{}", rf"\{{{_INNER}\}}"), ("<>", rf"<{_INNER}>"), ("##", rf"##{_INNER}##"),
)
ANY_SLOT = re.compile("|".join(p for _, p in STYLES))
LABELLED = re.compile(r"^[^\W\d_][\w -]*:\s+|^(?:fixes|closes|refs?|resolves|see)\s+", re.I)
FIELD = re.compile(r"([^\W\d_][\w /-]*):(?:\s+(.*))?$")
# Delimiters that hardly stand around anything but a variable; the others also mark tags and remarks.
STRICT_STYLES = frozenset(("{{}}", "${}", "$()", "<%%>", "[[]]", "@@", "__", "%%"))
HINT = re.compile(r"[{<\[@_%#$]")

HEADER = re.compile(
    r"commit [0-9a-f]{7,40}$|(?:author|date|from|to|cc|user|changeset|branch|parent|tag|author ?date|commit(?:ter)?(?: ?date)?|message-id|x-[\w-]+|index)\s*:\s"
    r"|r\d+ \| |signed-off-by:|co-authored-by:|reviewed-by:|acked-by:|tested-by:|change-id:",
    re.I,
)
TITLED = re.compile(r"(?:subject:\s*(?:\[[^\]]*\]\s*)?|summary:\s+(?=\S)(?=.*\S))", re.I)
DIFF = re.compile(r"^(?:diff --git |diff -r |Index: \S|--- \S+\t?.*\n\+\+\+ |@@ -\d)", re.M)
MERGE = re.compile(r"^(?:merge[d]? |revert ['\"])", re.I)


def split_record(text: str) -> tuple[list[str], str | None]:
    """The lines of a record's message without headers and indentation, and the diff behind it."""
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    m = DIFF.search(text)
    stripped = (line.strip() for line in (text[: m.start()] if m else text).split("\n"))
    return [line for line in stripped if line and not HEADER.match(line)], text[m.start() :] if m else None


def message_lines(text: str) -> tuple[list[str], bool]:
    """The lines of a record's message without headers and indentation, and whether a diff follows."""
    lines, diff = split_record(text)
    return [TITLED.sub("", line, count=1) if TITLED.match(line) else line for line in lines], diff is not None


def slot_name(raw: str) -> str:
    return re.sub(r"[\s._-]+", " ", raw).strip().lower()


def slots_of(line: str) -> list[tuple[str, str]]:
    """(style, name) of the slots of a line: names in delimiters that stand alone, behind a label, or at its end."""
    if not HINT.search(line):
        return []
    found = [(m.start(), m.end(), STYLES[m.lastindex - 1][0], slot_name(m.group(m.lastindex))) for m in ANY_SLOT.finditer(line)]
    if not found:
        return []
    label = LABELLED.match(line)
    rest = ANY_SLOT.sub("", line[label.end() if label and label.end() <= found[0][0] else 0 :])
    if not re.search(r"\w", rest):
        return [(style, name) for _, _, style, name in found]
    last = found[-1]
    return [last[2:]] if last[1] >= len(line.rstrip(" .:)")) and last[0] > 0 and line[last[0] - 1].isspace() else []


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def aligned_slots(line: str) -> list[tuple[str, str]]:
    """(fixed parts, value) of a line whose slot can be aligned with lines of other records: what stands behind a label,
    or a name at the end of a line. The value is "s" and the name if a name was left in place, else "c" and a digest."""
    label = LABELLED.match(line)
    slots = slots_of(line)
    if not slots:
        return [(slot_name(label[0]), "c" + digest(line[label.end() :]))] if label else []
    spans = [(m.start(), STYLES[m.lastindex - 1][0], slot_name(m.group(m.lastindex))) for m in ANY_SLOT.finditer(line)]
    if label and label.end() <= spans[0][0] and len(slots) == len(spans) and not re.search(r"\w", ANY_SLOT.sub("", line[label.end() :])):
        fixed, left = slot_name(label[0]), spans
    else:
        fixed, left = re.sub(r"\d+", "9", slot_name(line[: spans[-1][0]])), spans[-1:]
    return [(fixed, "s" + name) for _, style, name in left if style in STRICT_STYLES and re.search(r"\w", fixed)]


def form_of(lines: list[str]) -> list[tuple[str, str]]:
    """(label, value) of a message that is a form: two labels or more and nothing before the first."""
    fields: list[list[str]] = []
    for line in lines:
        if m := FIELD.fullmatch(line):
            fields.append([slot_name(m[1]), m[2] or ""])
        elif not fields:
            return []
        else:
            fields[-1][1] += "\n" + line
    return [(label, value.strip()) for label, value in fields] if len(fields) > 1 else []


def proposal(line: str) -> str | None:
    """The skeleton of a line that looks like residue; the corpus decides."""
    words = re.findall(r"[^\W\d_]+", line.lower())
    if len(words) >= 6 and sum(w in FILLER_WORDS for w in words) >= 0.7 * len(words):
        return "filler"
    if REPEATED.fullmatch(line):
        return "one word repeated"
    if TOOL.fullmatch(line) or INSTRUCTION.fullmatch(line) or SCRIPTS.search(line):
        return page_mask(re.sub(r"</?[a-z]+>", "", line)).strip()
    return None


def page_mask(line: str) -> str:
    """A line of a page, or a whole one, with what varies (numbers, hashes) masked."""
    return re.sub(r"\d+", "9", re.sub(r"\b(?=[0-9a-f]*\d)[0-9a-f]{7,40}\b", "h", line.lower()))


def skeleton(lines: list[str]) -> tuple[str, str] | None:
    """(skeleton, title) of an HTML page: a digest of all its lines with the title's text as slot."""
    page = "\n".join(lines)
    m = re.search(r"<title>\s*(.*?)\s*</title>", page, re.I | re.S)
    if not m or not m[1]:
        return None
    return digest(page_mask(page.replace(m[1], "\0"))), page_mask(m[1])


def leaves(lines: list[str]) -> list[list[str]]:
    """For each line its keys: the masked line with one word, each in turn, left open."""
    out = []
    for line in lines:
        words = page_mask(line).split()
        before, behind = [hashlib.blake2b(digest_size=8)], [hashlib.blake2b(digest_size=8)]
        for sums, order in ((before, words), (behind, words[::-1])):
            for w in order:
                sums.append(sums[-1].copy())
                sums[-1].update(w.encode("utf-8", "surrogatepass") + b" ")
        n = len(words)
        out.append([f"{n}:{k}:{before[k].hexdigest()}{behind[n - k - 1].hexdigest()}" for k in range(n)])
    return out


def evidence(text: str | None) -> list[tuple[str, str, str]]:
    """(kind, key, detail) of what a record shows, to be judged by the corpus: 'told' (a proposed skeleton and the
    record's content), 'leaf' (a line of a proposed page), 'slot', 'line', 'form', 'title' and 'page'. A content of
    '' stands for a record that is nothing but proposed lines and tags."""
    if text is None or not text.strip():
        return []
    lines, has_diff = message_lines(text)
    if not lines:
        return []
    out: list[tuple[str, str, str]] = []
    raw, diff = split_record(text)
    changed = digest("\n".join(x for x in diff.split("\n") if x[:1] in ("+", "-")) if diff else "\n".join(raw))
    proposed = [proposal(line) for line in lines]
    content = changed if diff or any(p is None and not re.fullmatch(r"(?:<[^>]*>\s*)+", x) for p, x in zip(proposed, lines)) else ""
    tags = not has_diff and re.match(r"<(?:!doctype|html)", lines[0], re.I) is not None  # names in <> are no slots
    if not has_diff and not MERGE.match(lines[0]):
        whole = "\n".join(lines)
        if ERROR_OBJECT.fullmatch(whole):
            out.append(("told", "object:" + re.sub(r'(?<=:)\s*"[^"]*"', "s", page_mask(whole)), ""))
        if TITLE.fullmatch(lines[0]):
            out.append(("told", "page:" + page_mask(lines[0]), content))
            out.extend(("leaf", key, f"{content}:{k}:{len(lines) - 1}") for k, keys in enumerate(leaves(lines[1:])) for key in keys)
        if (s := skeleton(lines)) is not None:
            if TITLE.fullmatch(s[1].replace("9", "4").replace("444", "404")) or tags:
                out.append(("title", s[1], s[0]))
        else:
            out.append(("page", page_mask(lines[0]), ""))
    for line, p in zip(lines, proposed):
        if p is not None:
            out.append(("told", p, content))
        out.extend(("slot", name, style) for style, name in slots_of(line) if not (tags and style == "<>"))
        out.extend(("line", fixed, value) for fixed, value in aligned_slots(line))
    if form := form_of(raw):
        labels = digest("\n".join(label for label, _ in form))
        out.extend(("form", f"{labels}:{k}", f"{digest(value) if value else ''}:{changed}") for k, (_, value) in enumerate(form))
    return out


def evidence_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, key, detail) of every record that shows any."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, at = b.column("doc_id"), [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                for kind, key, detail in dict.fromkeys(evidence(text)):
                    rows.append((kind, key, f"doc {ids[k]}" if kind == "told" and not detail else detail))
                    at.append(k)
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in cols)], ["doc_id", "kind", "key", "detail"]
            )

    return documents.select("doc_id", "text").where("text is not null").mapInArrow(
        scan, "doc_id bigint, kind string, key string, detail string"
    )


def aligned_names(lines: DataFrame, least_records: int) -> DataFrame:
    """(doc_id, key, name) of each name left at a position that varies over the records aligned there."""
    varying = lines.groupBy("key").agg(F.count_distinct("detail").alias("values"), F.count_distinct("doc_id").alias("records"))
    varying = varying.where((F.col("values") > 1) & (F.col("records") >= least_records))
    return lines.where("detail like 's%'").join(varying.select("key"), "key", "left_semi").select("doc_id", "key", F.expr("substr(detail, 2)").alias("name"))


def form_documents(fields: DataFrame, least_records: int) -> DataFrame:
    """(doc_id) of forms all of whose fields are blank or keep what the template had there.

    A default is kept by several records of different content, at a position that has as many values beside it. The
    sequence of labels must be that of several records of different content.
    """
    of_form = F.split("key", ":")[0]
    parts = fields.select("doc_id", "key", F.split("detail", ":")[0].alias("value"), F.split("detail", ":")[1].alias("content"), of_form.alias("form"))
    kept = parts.where("value <> ''").groupBy("key", "value").agg(F.count_distinct("content").alias("n"))
    varying = kept.groupBy("key").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= least_records)
    defaults = kept.where(F.col("n") >= least_records).join(varying, "key", "left_semi").select("key", "value", F.lit(True).alias("own"))
    judged = parts.join(defaults, ["key", "value"], "left").withColumn("empty", F.col("own").isNotNull() | (F.col("value") == ""))
    of_text = judged.groupBy("doc_id", "form", "content").agg(F.min("empty").alias("empty"))
    aligned = parts.groupBy("form").agg(F.count_distinct("content").alias("records")).where(F.col("records") >= least_records)
    return of_text.where("empty").join(aligned.select("form"), "form", "left_semi").select("doc_id")


def told_documents(told: DataFrame, leaf: DataFrame, least_records: int) -> DataFrame:
    """(doc_id) of records with a proposed line, or a proposed page, that recurs in records of different content."""
    recurring = told.groupBy("key").agg(F.count_distinct("detail").alias("records")).where(F.col("records") >= least_records)
    found = told.join(recurring.select("key"), "key", "left_semi")
    # A page must be aligned in all its lines.
    lines = leaf.select("doc_id", "key", *[F.split("detail", ":")[k].alias(n) for k, n in enumerate(("content", "line", "lines"))])
    shared = lines.groupBy("key").agg(F.count_distinct("content").alias("records")).where(F.col("records") >= least_records)
    met = lines.join(shared.select("key"), "key", "left_semi").groupBy("doc_id", "content", "lines").agg(F.count_distinct("line").alias("n"))
    whole = met.where(F.col("n") == F.col("lines").cast("int")).select("doc_id", F.col("content").alias("detail"))
    alone = F.col("key").startswith("page:") & ~F.col("detail").startswith("doc ")
    pages = found.where(alone).join(whole, ["doc_id", "detail"], "left_semi")
    return found.where(~alone).select("doc_id").unionByName(pages.select("doc_id"))


def residue_documents(documents: DataFrame, least_styles: int = 2, least_records: int = 3) -> DataFrame:
    """(doc_id) of each record in which residue stands in place of content.

    least_styles, least_records: under how many kinds of delimiters (or at how many aligned positions) and in how many
    records a name must have been left in place to count as a variable's name; in how many records a position, a
    default, a proposed line or an HTML skeleton must repeat.
    """
    rows = materialise(evidence_rows(documents))
    slots = rows.where("kind = 'slot'")
    names = slots.groupBy("key").agg(F.count_distinct("detail").alias("styles"), F.approx_count_distinct("doc_id").alias("records"))
    known = names.where((F.col("styles") >= least_styles) & (F.col("records") >= least_records))
    at_lines, by_form = aligned_names(rows.where("kind = 'line'"), least_records), form_documents(rows.where("kind = 'form'"), least_records)
    induced = at_lines.groupBy("name").agg(F.count_distinct("key").alias("positions")).where(F.col("positions") >= least_styles)
    known = known.select("key").unionByName(induced.select(F.col("name").alias("key"))).distinct()
    by_slot = slots.join(known, "key", "left_semi").select("doc_id").unionByName(at_lines.select("doc_id")).unionByName(by_form)
    titles = rows.where("kind = 'title'")
    repeated = titles.groupBy("detail").agg(F.count_distinct("doc_id").alias("records")).where(F.col("records") >= least_records)
    pages = titles.join(repeated.select("detail"), "detail", "left_semi")
    plain = rows.where("kind = 'page'").join(pages.select("key").distinct(), "key", "left_semi")
    told = told_documents(rows.where("kind = 'told'"), rows.where("kind = 'leaf'"), least_records)
    return told.unionByName(by_slot).unionByName(pages.select("doc_id")).unionByName(plain.select("doc_id")).distinct()
