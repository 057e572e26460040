"""Table functions for SQL: register(spark) makes label_matches, ocr_tokens and pdf_pages callable in FROM and LATERAL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Lines that a label's value may lie ahead, longest label, least length of a value.
AHEAD, LONGEST_LABEL, LEAST_VALUE = 4, 39, 40


@udtf(returnType="doc_id bigint, pos bigint, value string")
class LabelMatches:
    """label_matches(TABLE(doc_id, pos, line) PARTITION BY doc_id ORDER BY pos): short lines (labels), each with the next line
    that isn't blank among the four after it, if that is long enough to be a value.

    Held are the labels of the last four lines that still wait, whatever the length of a document."""

    def __init__(self):
        self.waiting: list[tuple[int, int, int]] = []

    def eval(self, row):
        line = (row["line"] or "").strip(" ")
        self.waiting = [(doc, pos, left - 1) for doc, pos, left in self.waiting if left > 0]
        if line:
            if len(line) >= LEAST_VALUE:
                for doc, pos, _ in self.waiting:
                    yield doc, pos, line
            self.waiting = []
            if len(line) <= LONGEST_LABEL:
                self.waiting = [(row["doc_id"], row["pos"], AHEAD)]


@udtf(returnType="block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string", useArrow=True)
class OcrTokens:
    """ocr_tokens(table of a reader, as tab-separated text with a heading): its words that have a confidence and aren't blank."""

    NAMES = ("block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height")

    def eval(self, table: str):
        lines = (table or "").split("\n")
        names = {name: i for i, name in enumerate(lines[0].rstrip("\r").split("\t"))}
        if not {*self.NAMES, "conf", "text"} <= names.keys():
            return
        for line in lines[1:]:
            cells = line.rstrip("\r").split("\t")
            try:
                conf = float(cells[names["conf"]])
                places = [int(cells[names[name]]) for name in self.NAMES]
                text = cells[names["text"]]
            except (ValueError, IndexError):
                continue
            if conf >= 0 and text.strip():
                yield *places, conf, text


@udtf(returnType="page int, width int, height int, image binary")
class PdfPages:
    """pdf_pages(content, detail): the first pages of a PDF file in order, each with its largest embedded image."""

    def eval(self, content: bytes, detail: bool):
        from credenza.sources import pages

        yield from pages.pages_of(None if content is None else bytes(content), least_detail=pages.LEAST_DETAIL if detail else 0)


def register(spark: SparkSession) -> None:
    for name, function in (("label_matches", LabelMatches), ("ocr_tokens", OcrTokens), ("pdf_pages", PdfPages)):
        spark.udtf.register(name, function)
