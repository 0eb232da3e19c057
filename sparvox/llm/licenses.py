"""License scans by canonical digest, in DataFrame operations only.

A text's canonical form has no case, punctuation, copyright lines or spelling variants; its digest is hash-joined with the
digests of known licence texts in the same form. So whole texts are found however they are set, and nothing is found in
part. A copyright line goes where it stands as a line of its own.

The digest that is returned is of that form. Licences are also looked up by a second one, which drops only copyright lines that name a year
or holder, and title lines, list numbers and the holder's name in BSD's third clause; it is made of `texts()`: KNOWN, more notices and the
whole texts in license_texts. The SQL states the first form with KNOWN alone.

Defined results: null and empty texts have the digest of the empty form and no licence; null doc_ids and repeated rows pass.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored

#: Spellings that count as equal, as the SPDX matching guidelines list them.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize",
    "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while",
    "wilfull": "wilful", "noncommercial": "non commercial", "percent": "per cent", "sublicence": "sublicense",
}

#: Texts of well-known short licences and of one-line notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
}

COPYRIGHT_LINE = r"(?im)^[\x20\x09*/#;.-]*(?:copyright\b|\(c\)|©).*$"


#: More one-line notices.
NOTICES = {
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
}

YEAR = r"[<\[{]?(?:\d{4}|years?\b|yyyy)"
OWNER_LINE = rf"(?im)^[\x20\x09*/#;.-]*(?:copyright[\x20\x09]*(?:\(c\)|©|{YEAR})|\(c\)[\x20\x09]*(?:copyright\b|{YEAR})|©|copyright\b.*\b(?:19|20)\d\d\b|all rights reserved\.?[\x20\x09]*$).*$"
TITLE_LINE = r"(?im)^[\x20\x09*/#]*(?:the[\x20])?(?:mit|isc|(?:zero[\x20-]clause|0-clause)[\x20]bsd|bsd[\x20]zero[\x20]clause|(?:bsd[\x20])?[23]-clause(?:[\x20]bsd)?|bsd)[\x20]licen[cs]e(?:[\x20]\((?:mit|isc|0bsd|bsd-[23]-clause)\))?:?[\x20\x09]*$"
LIST_NUMBER = r"(?im)^[\x20\x09]*(?:\d{1,2}|[a-z])[.)][\x20\x09]+"
HOLDER = r"neither the name of (?:[^\x20]+\x20){1,16}?nor the names"


def texts() -> dict[str, str]:
    """All known texts and notices by licence."""
    whole = {f.name.removesuffix(".txt"): f.read_text() for f in files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
    return {**whole, **NOTICES, **KNOWN}


def lookup_form(text: Column) -> Column:
    """The canonical form without title lines, list numbers and holders, and with the lines of the text that only begin with 'copyright'."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "")
    for line in (OWNER_LINE, TITLE_LINE, LIST_NUMBER):
        text = F.regexp_replace(text, line, " ")
    return F.regexp_replace(_spelt(text), HOLDER, "neither the name of the copyright holder nor the names")


def canonical(text: Column) -> Column:
    """Lower-case words of letters and digits with single spaces; no copyright lines; one spelling."""
    return _spelt(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, " "))


def _spelt(text: Column) -> Column:
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    spelt = F.transform(F.split(F.trim(words), " "), lambda w: F.coalesce(F.element_at(_spellings(), w), w))
    return F.array_join(spelt, " ")


def _spellings() -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(EQUIVALENT.items()) for x in pair])


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license_id) of every document, license_id null where its whole text is no known licence (license_id, text).

    Two licences with one canonical form count as the first by name. Spark broadcasts the known digests only while they are small."""
    forms = known.select("license_id", F.explode(F.array(canonical(F.col("text")), lookup_form(F.col("text")))).alias("form"))
    table = stored(forms.where("form <> ''").groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id")))
    found = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.sha2(lookup_form(F.col("text")), 256).alias("looked_up"))
    found = found.join(table, "digest", "left").join(table.select(F.col("digest").alias("looked_up"), F.col("license_id").alias("other")), "looked_up", "left")
    return found.select("doc_id", "digest", F.coalesce("license_id", "other").alias("license_id"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(sorted(texts().items()), "license_id string, text string")
    return scan(documents(spark, sf_dir), known)


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    spelt = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in sorted(EQUIVALENT.items()))
    words = lambda t: rf"trim(regexp_replace(lower(regexp_replace(coalesce({t}, ''), '{COPYRIGHT_LINE}', ' ', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    form = lambda t: f"array_to_string(list_transform(string_split({words(t)}, ' '), lambda w: CASE w {spelt} ELSE w END), ' ')"
    known = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in sorted(KNOWN.items()))
    return f"""
WITH known(license_id, text) AS (VALUES {known}),
digests AS (SELECT sha256({form("text")}) AS digest, min(license_id) AS license_id FROM known WHERE {form("text")} <> '' GROUP BY 1),
scanned AS (SELECT doc_id, sha256({form("text")}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM scanned LEFT JOIN digests USING (digest)
"""


OP8_SQL = _sql()
