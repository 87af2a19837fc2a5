"""Licence scan by sentence rules, in SQL functions only.

Hard-wrapped lines (and the leaders of comment lines) are joined, so that a
sentence is seen whole. A text is cut into sentences; a sentence with a licence word is normalised and
mapped to the identifier of the first sentence rule it matches (``Unknown`` if
none does). The identifiers, in text order, form a sequence; at each place the
first licence rule that matches consumes the identifiers it covers, so whole
licence texts, which stand first, win over single statements.

Scale: everything is row-local JVM work on one column (no shuffle, no Python);
both rule tables are fixed.

Defined results: null and empty texts have no sentences and empty strings;
repeated rows are scanned one by one; an empty table gives an empty result; a
very long text is matched in linear time; extra columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words without which no sentence rule can match.
CUE = (r"licen[sc]e|copyright|redistribut|warrant|permission|rights reserved|public domain|creative commons|"
       r"cc by|cc0|provided (by .{0,400} )?as is|neither the names? of")

# Sentence identifiers and their patterns over a normalised
# sentence (lower case; signs as single spaces; full stops only inside numbers).
# A gap in a pattern spans 400 characters at most, so the time of a match is linear.
SENTENCES = (
    ("SpdxApache2", r"spdx license identifier apache 2\.0"),
    ("SpdxMit", r"spdx license identifier mit"),
    ("SpdxGpl3", r"spdx license identifier gpl 3\.0"),
    ("SpdxGpl2", r"spdx license identifier gpl 2\.0"),
    ("SpdxOther", r"spdx license identifier"),
    ("MitPermission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MitNotice", r"above copyright notice and this permission notice shall be included"),
    ("IscPermission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("BsdSource", r"redistributions? of source code must retain"),
    ("BsdBinary", r"redistributions? in binary form must reproduce"),
    ("BsdEndorse", r"neither the names? of .{0,400}(endorse|promote)"),
    ("BsdPermitted", r"redistribution and use in source and binary forms"),
    ("Apache2Comply", r"not use this (file|work) except in compliance with the license"),
    ("LicenseCopyAt", r"you may obtain a copy of the license"),
    ("Apache2AsIs", r"distributed under the license is distributed on an as is basis"),
    ("AsIs", r"(software|work|material) is provided (by .{0,400} )?as is|without warrant(y|ies) (or conditions )?of any kind"),
    ("Apache2Grant", r"apache license,? (version )?2|apache 2\.0 license"),
    ("ApacheGrant", r"apache (software )?license"),
    ("MitGrant", r"mit license"),
    ("IscGrant", r"isc license"),
    ("Bsd3Grant", r"(3 clause|three clause|new|modified) bsd|bsd 3 clause"),
    ("Bsd2Grant", r"(2 clause|two clause|simplified) bsd|bsd 2 clause"),
    ("BsdGrant", r"bsd license"),
    ("Agpl3Grant", r"affero general public license (v|version )?3"),
    ("AgplGrant", r"affero general public license"),
    ("Lgpl3Grant", r"(lesser|library) general public license (as published .{0,400})?(v|version )?3"),
    ("Lgpl2Grant", r"(lesser|library) general public license (as published .{0,400})?(v|version )?2"),
    ("LgplGrant", r"(lesser|library) general public license"),
    ("Gpl3Plus", r"general public license .{0,400}(v|version )3.{0,400} or .{0,400}later"),
    ("Gpl3Grant", r"general public license (as published .{0,400})?(v|version )?3"),
    ("Gpl2Plus", r"general public license .{0,400}(v|version )2.{0,400} or .{0,400}later"),
    ("Gpl2Grant", r"general public license (as published .{0,400})?(v|version )?2"),
    ("GplCopy", r"received a copy of the gnu general public license"),
    ("GplGrant", r"general public license"),
    ("Mpl2Grant", r"mozilla public license (v|version )?2"),
    ("CcByNcNd", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv"),
    ("CcByNcSa", r"cc by nc sa|creative commons attribution non ?commercial share ?alike"),
    ("CcByNc", r"cc by nc|creative commons attribution non ?commercial"),
    ("CcByNd", r"cc by nd|creative commons attribution no ?deriv"),
    ("CcBySa", r"cc by sa|creative commons attribution share ?alike"),
    ("Cc0", r"cc0|creative commons zero"),
    ("CcBy", r"cc by|creative commons attribution"),
    ("PublicDomain", r"public domain"),
    ("AllRights", r"all rights reserved"),
    ("CopyrightNotice", r"^copyright .{0,400}(19|20)[0-9][0-9]|copyright c"),
)

# Licences and their sequences of sentence identifiers, in order.
LICENSES = (
    ("MIT", r"(<CopyrightNotice>)?<MitPermission>(<MitNotice>)?(<AsIs>)*"),
    ("ISC", r"(<CopyrightNotice>)?<IscPermission>(<AsIs>)*"),
    ("BSD-3-Clause", r"(<BsdPermitted>)?<BsdSource><BsdBinary><BsdEndorse>(<AsIs>)*"),
    ("BSD-2-Clause", r"(<BsdPermitted>)?<BsdSource><BsdBinary>(<AsIs>)*"),
    ("Apache-2.0", r"<Apache2Grant>(<Apache2Comply>|<LicenseCopyAt>|<Apache2AsIs>|<AsIs>)*"),
    ("Apache-2.0", r"<SpdxApache2>"),
    ("GPL-3.0-or-later", r"<Gpl3Plus>(<AsIs>|<GplCopy>)*"),
    ("GPL-2.0-or-later", r"<Gpl2Plus>(<AsIs>|<GplCopy>)*"),
    ("AGPL-3.0", r"<Agpl3Grant>(<AsIs>)*"),
    ("LGPL-3.0", r"<Lgpl3Grant>(<AsIs>)*"),
    ("LGPL-2.0", r"<Lgpl2Grant>(<AsIs>)*"),
    ("GPL-3.0", r"<Gpl3Grant>(<AsIs>|<GplCopy>)*|<SpdxGpl3>"),
    ("GPL-2.0", r"<Gpl2Grant>(<AsIs>|<GplCopy>)*|<SpdxGpl2>"),
    ("AGPL", r"<AgplGrant>"),
    ("LGPL", r"<LgplGrant>"),
    ("GPL", r"<GplGrant>|<GplCopy>"),
    ("MIT", r"<MitGrant>(<AsIs>)*|<SpdxMit>"),
    ("ISC", r"<IscGrant>"),
    ("BSD-3-Clause", r"<Bsd3Grant>"),
    ("BSD-2-Clause", r"<Bsd2Grant>"),
    ("BSD", r"<BsdGrant>|<BsdPermitted>"),
    ("Apache", r"<ApacheGrant>"),
    ("MPL-2.0", r"<Mpl2Grant>"),
    ("CC-BY-NC-ND", r"<CcByNcNd>"),
    ("CC-BY-NC-SA", r"<CcByNcSa>"),
    ("CC-BY-NC", r"<CcByNc>"),
    ("CC-BY-ND", r"<CcByNd>"),
    ("CC-BY-SA", r"<CcBySa>"),
    ("CC0", r"<Cc0>"),
    ("CC-BY", r"<CcBy>"),
    ("Public-Domain", r"<PublicDomain>"),
    ("All-Rights-Reserved", r"(<CopyrightNotice>)?<AllRights>"),
    ("SPDX-Other", r"<SpdxOther>"),
)

# a sentence ends at a line feed, or at a closing mark before white space
SENTENCE_END = r"\n|[.!?;]+[ \t\r]+"

# A line that starts a sentence of its own (list marker, notice, comment, quote), and one that goes on.
_OWN_LINE = (r"[ \t]*(?:\r?\n|\r?$|[-+*•‣◦#>|;%/=_~]|(?i:dnl|rem)\b|\(?(?:[0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)][ \t]"
             r"|(?i:copyright\b|\(c\)|©|spdx|all rights reserved))")
_GOES_ON = r"[ \t]*(?:[a-z]|(?i:version[ \t]+[0-9]))"
# a line feed inside a sentence: after a line of some length, or before a line that goes on
WRAP = rf"[ \t\r]*(?<=\S[ \t\r]{{0,8}})\n(?!{_OWN_LINE})(?:(?<=[^\n]{{40}}\n)|(?={_GOES_ON}))[ \t]*"
# comment lines after a line with the same leader, and inside /* */
COMMENT = r"\n(?=[ \t]*(?:[/#;%-]|dnl\b))(?:" + "|".join(
    rf"(?<=(?:^|\n)[ \t]{{0,40}}{x}[^\n]{{0,400}}\n)[ \t]*{x}" for x in (
        "/{2,9}", "#{1,9}", ";{1,9}", "-{2,9}", "%{1,9}", "dnl")) + r")[ \t]*"
STARRED = r"\n[ \t]*\*(?![*/])[ \t]*"
_SIGNS = r"[^a-z0-9.]+"
_STOPS = r"\.+( |$)|(^| )\.+"


def unwrapped(text: Column) -> Column:
    """Text with the line feeds inside its sentences, and the leaders of its comment lines, as spaces."""
    starred = F.when(text.contains("/*") & text.rlike(r"(?m)^[ \t]*/\*"), F.regexp_replace(text, STARRED, "\n")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(starred, COMMENT, "\n"), WRAP, " ")


def normalised(sentence: Column) -> Column:
    low = F.regexp_replace(F.lower(sentence), _SIGNS, " ")
    return F.trim(F.regexp_replace(low, _STOPS, " "))


def sentence_id(sentence: Column) -> Column:
    """Identifier of the first sentence rule that a normalised sentence matches."""
    name, pattern = SENTENCES[0]
    out = F.when(sentence.rlike(pattern), name)
    for name, pattern in SENTENCES[1:]:
        out = out.when(sentence.rlike(pattern), name)
    return out.otherwise("Unknown")


def _iterated(pattern: str) -> str:
    """The pattern with possessive repetitions: nothing follows them that could
    take an identifier back, and the JVM then matches any number of identifiers
    in a loop (a plain repeated group recurses once for each)."""
    return pattern.replace(")*", ")*+")


def license_of(sequence: Column) -> Column:
    """Licence of the first rule that covers a whole sequence of identifiers."""
    name, pattern = LICENSES[0]
    out = F.when(sequence.rlike(f"^(?:{_iterated(pattern)})$"), name)
    for name, pattern in LICENSES[1:]:
        out = out.when(sequence.rlike(f"^(?:{_iterated(pattern)})$"), name)
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, sentence_ids, licenses, n_licenses, unmatched) per document.

    ``n_sentences`` counts the sentences with a licence word; ``licenses`` are
    the different ones in text order, joined by commas; ``unmatched`` are the
    identifiers left over.
    """
    parts = F.split(unwrapped(F.coalesce(F.col(text_col), F.lit(""))), SENTENCE_END)
    cued = F.filter(F.transform(parts, normalised), lambda s: s.rlike(CUE))
    out = df.select(F.col(id_col), cued.alias("found"))
    out = out.select(id_col, F.size("found").cast("long").alias("n_sentences"),
                     F.transform("found", lambda s: F.concat(F.lit("<"), sentence_id(s), F.lit(">"))).alias("ids"))
    out = out.select(id_col, "n_sentences", F.array_join("ids", "").alias("sentence_ids"))
    # at each place the first rule that matches consumes its identifiers
    rules = "|".join(f"(?:{_iterated(pattern)})" for _, pattern in LICENSES)
    used = F.regexp_extract_all(F.col("sentence_ids"), F.lit(f"({rules})"), F.lit(1))
    named = F.transform(used, license_of)
    return out.select(
        id_col, "n_sentences", "sentence_ids", F.array_join(F.array_distinct(named), ",").alias("licenses"),
        F.size(used).cast("long").alias("n_licenses"),
        F.regexp_replace("sentence_ids", rules, "").alias("unmatched"))


def oracle_sql() -> str:
    """The same scan in DuckDB SQL over ``documents``."""
    def case(value: str, rules, otherwise: str) -> str:
        whens = " ".join(f"WHEN regexp_matches({value}, '{p}') THEN '{n}'" for n, p in rules)
        return f"CASE {whens} {otherwise} END"

    rules = "|".join(f"(?:{p})" for _, p in LICENSES)
    sentence = case("s", SENTENCES, "ELSE 'Unknown'")
    licence = case("m", [(n, f"^(?:{p})$") for n, p in LICENSES], "")
    return rf"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '{SENTENCE_END}'), lambda s:
    trim(regexp_replace(regexp_replace(lower(s), '{_SIGNS}', ' ', 'g'), '{_STOPS}', ' ', 'g'))),
    lambda s: regexp_matches(s, '{CUE}')) AS found
  FROM documents),
ids AS (
  SELECT doc_id, CAST(len(found) AS BIGINT) AS n_sentences,
         coalesce(array_to_string(list_transform(found, lambda s: '<' || {sentence} || '>'), ''), '') AS sentence_ids
  FROM cut),
used AS (SELECT *, regexp_extract_all(sentence_ids, '{rules}') AS used FROM ids),
named AS (SELECT *, list_transform(used, lambda m: {licence}) AS named FROM used)
SELECT doc_id, n_sentences, sentence_ids,
       coalesce(array_to_string(list_filter(named, lambda x, i: list_position(named, x) = i), ','), '') AS licenses,
       CAST(len(used) AS BIGINT) AS n_licenses, regexp_replace(sentence_ids, '{rules}', '', 'g') AS unmatched
FROM named"""
