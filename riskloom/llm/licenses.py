"""License scans by sentence rules: sentences become identifiers, sequences of identifiers become licences.

Lines of a paragraph are joined and cut into sentences, sentences are normalised to words, what is known in them gets
identifiers, and ordered rules are matched against the sequence of identifiers; what a rule matches is taken out before the
next one. A sentence may name several licences; one that it denies is none. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import whole

#: Every pattern of SENTENCES needs one of these words (tests/llm holds each against it), so a text without them has no
#: licence sentence; cheap to test.
HINT = r"(?i)licen[cs]e|copyright|permission|redistribut|domain|warrant|reserved|unencumbered|endorse|creative|\bcc|mozilla|misrepresented"

#: Identifier and what the normalised sentence holds; the first that fits counts. Letters are a-z, all else is one blank.
SENTENCES = (
    ("spdx_mit", r"^.*spdx license identifier mit$"),
    ("spdx_apache2", r"^.*spdx license identifier apache 2 0$"),
    ("spdx_bsd3", r"^.*spdx license identifier bsd 3 clause$"),
    ("spdx_gpl3", r"^.*spdx license identifier gpl 3 0( only| or later)?$"),
    ("spdx_gpl2", r"^.*spdx license identifier gpl 2 0( only| or later)?$"),
    ("spdx_agpl3", r"^.*spdx license identifier agpl 3 0( only| or later)?$"),
    ("spdx_lgpl3", r"^.*spdx license identifier lgpl 3 0( only| or later)?$"),
    ("spdx_lgpl21", r"^.*spdx license identifier lgpl 2 1( only| or later)?$"),
    ("spdx_bsd2", r"^.*spdx license identifier bsd 2 clause$"),
    ("spdx_isc", r"^.*spdx license identifier isc$"),
    ("spdx_mpl2", r"^.*spdx license identifier mpl 2 0$"),
    ("spdx_epl2", r"^.*spdx license identifier epl 2 0$"),
    ("spdx_bsl1", r"^.*spdx license identifier bsl 1 0$"),
    ("spdx_zlib", r"^.*spdx license identifier zlib$"),
    ("spdx_unlicense", r"^.*spdx license identifier unlicense$"),
    ("spdx_cc0", r"^.*spdx license identifier cc0 1 0$"),
    ("ccbyncnd", r"\b(licensed|released|available|distributed|is) under (the |a )?(cc|creative commons) (by nc nd|attribution noncommercial noderivatives)"),
    ("ccbyncsa", r"\b(licensed|released|available|distributed|is) under (the |a )?(cc|creative commons) (by nc sa|attribution noncommercial sharealike)"),
    ("ccbync", r"\b(licensed|released|available|distributed|is) under (the |a )?(cc|creative commons) (by nc|attribution non ?commercial)"),
    ("ccbysa", r"\b(licensed|released|available|distributed|is) under (the |a )?(cc|creative commons) (by sa|attribution share ?alike)"),
    ("ccby", r"\b(licensed|released|available|distributed|is) under (the |a )?(cc|creative commons) (by|attribution)"),
    ("cc0", r"\b(cc0|creative commons zero)\b"),
    ("lgpl3", r"(licensed under|released under|under the terms of) the gnu lesser general public license .*version 3"),
    ("lgpl21", r"(licensed under|released under|under the terms of) the gnu lesser general public license .*version 2 1"),
    ("lgpl", r"(licensed under|released under|under the terms of) the gnu lesser general public license"),
    ("agpl3", r"(licensed under|released under|under the terms of) the gnu affero general public license .*version 3"),
    ("agpl", r"(licensed under|released under|under the terms of) the gnu affero general public license"),
    ("gpl3", r"(licensed under|released under|under the terms of) the gnu general public license .*version 3"),
    ("gpl2", r"(licensed under|released under|under the terms of) the gnu general public license .*version 2"),
    ("gpl", r"(licensed under|released under|under the terms of) the gnu general public license"),
    ("apache2", r"\b(licensed|released|available|distributed|is) under the apache license version 2 0"),
    ("apache_copy", r"you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache_basis", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("mpl2", r"subject to the terms of the mozilla public license v(ersion)? ?2 0"),
    ("mpl2_copy", r"if a copy of the mpl was not distributed with this file you can obtain one at https? (www )?mozilla org mpl 2 0"),
    ("epl2", r"\b(licensed|released|available|distributed|is) under the terms of the eclipse public license v? ?2 0"),
    ("boost_grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost_short", r"distributed under the boost software license version 1 0"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib_origin", r"the origin of this software must not be misrepresented"),
    ("gpl_hope", r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl_copy", r"you should have received a copy of the gnu (lesser |affero )?general public license"),
    ("mit_short", r"\b(licensed|released|available|distributed|is) under the (terms of the )?mit license"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included"),
    ("isc_grant", r"permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", r"neither the names? of .* may be used to endorse or promote"),
    ("bsd_short", r"\b(licensed|released|available|distributed|is) under the (3 clause |2 clause |new |modified )?bsd license"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public", r"(placed in|dedicated to|released into) the public domain"),
    ("as_is", r"software is provided (by .* )?as is (and|without) (any )?(express or implied )?warrant"),
    ("reserved", r"all rights reserved"),
    ("copyright", r"^(c )?copyright (c )?[0-9]{4}"),
)

#: Licence and the sequence of identifiers that states it, in the order the rules are tried. Identifiers stand as <id>.
RULES = (
    ("BSD-3-Clause", "<bsd_grant>(<bsd_source>)?(<bsd_binary>)?<bsd_endorse>(<as_is>)?"),
    ("BSD-2-Clause", "<bsd_grant>(<bsd_source>)?(<bsd_binary>)?(<as_is>)?"),
    ("BSD-2-Clause", "<spdx_bsd2>"),
    ("BSD", "<bsd_short>"),
    ("BSL-1.0", "(<boost_grant>|<boost_short>|<spdx_bsl1>)(<as_is>)?"),
    ("Zlib", "(<as_is>)?<zlib_grant>(<zlib_origin>)?"),
    ("Zlib", "(<zlib_origin>|<spdx_zlib>)"),
    ("MIT", "<mit_grant>(<mit_notice>)?(<as_is>)?"),
    ("MIT", "(<mit_short>|<spdx_mit>)+"),
    ("ISC", "(<isc_grant>|<spdx_isc>)(<as_is>)?"),
    ("Apache-2.0", "(<apache2>|<spdx_apache2>)+(<apache_copy>)?(<apache_basis>)?"),
    ("BSD-3-Clause", "<spdx_bsd3>"),
    ("GPL-3.0", "(<gpl3>|<spdx_gpl3>)+(<gpl_hope>)?(<gpl_copy>)?"),
    ("GPL-2.0", "(<gpl2>|<spdx_gpl2>)+(<gpl_hope>)?(<gpl_copy>)?"),
    ("AGPL-3.0", "(<agpl3>|<spdx_agpl3>)+(<gpl_hope>)?(<gpl_copy>)?"),
    ("AGPL", "<agpl>(<gpl_hope>)?(<gpl_copy>)?"),
    ("LGPL-3.0", "(<lgpl3>|<spdx_lgpl3>)+(<gpl_hope>)?(<gpl_copy>)?"),
    ("LGPL-2.1", "(<lgpl21>|<spdx_lgpl21>)+(<gpl_hope>)?(<gpl_copy>)?"),
    ("LGPL", "<lgpl>(<gpl_hope>)?(<gpl_copy>)?"),
    ("GPL", "<gpl>(<gpl_hope>)?(<gpl_copy>)?"),
    ("MPL-2.0", "(<mpl2>|<mpl2_copy>|<spdx_mpl2>)+"),
    ("EPL-2.0", "(<epl2>|<spdx_epl2>)"),
    ("CC-BY-NC-ND", "<ccbyncnd>"),
    ("CC-BY-NC-SA", "<ccbyncsa>"),
    ("CC-BY-NC", "<ccbync>"),
    ("CC-BY-SA", "<ccbysa>"),
    ("CC-BY", "<ccby>"),
    ("CC0", "(<cc0>|<spdx_cc0>)"),
    ("Unlicense", "(<unlicense>|<spdx_unlicense>)(<as_is>)?"),
    ("Public-Domain", "<public>"),
    ("All-Rights-Reserved", "(<copyright>)?<reserved>"),
)


#: Paragraphs also end after a line with an SPDX identifier and before a line with a copyright and its year. A line that ends
#: in "at" goes on after blank lines, as the address of a licence stands apart.
PARAGRAPHS = ((r"\r\n?", "\n"), (r"(spdx-license-identifier[^\n]*)\n", "$1\n\n"), (r"\n(?=[^a-z0-9\n]*(c[^a-z0-9\n]+)?copyright[^a-z0-9\n]+(c[^a-z0-9\n]+)?[0-9]{4})", "\n\n"), (r"\bat[^a-z0-9\n]*\n([^a-z0-9\n]*\n)+", "at\n"), (r"\n[^a-z0-9\n]*(?=\n)", "\x01"), (r"\n", " "), (r"\bv\. +([0-9])", "v $1"), (r"([.!?])[ \t]+", "$1\x01"))
#: Where a sentence names its first licence. What follows may name more, as if it repeated the words before the first.
FIRST = r"\b(licensed|released|available|distributed|is) under |spdx license identifier "
AGAIN = (
    (r"under either( of)?( the)? ", "under the "),
    (r" (or|and|and or)( under)?(?= (the |a )?(terms of the )?(mit license|apache license|(3 clause |2 clause |new |modified )?bsd license|gnu (lesser |affero )?general public license|cc by|creative commons))", " licensed under"),
    (r"(?<=licensed under) (?=(mit|apache|bsd|gnu) )", " the "),
)
AGAIN_SPDX = r" (or|and|with)(?! later)(?= )", " spdx license identifier"
#: A licence that is denied is none: what follows these words names nothing.
DENIED = r"\b(not|never|no longer|nor) (licensed|released|available|distributed|placed|dedicated|be used) (under|to|in|into) "


def _within(pattern: str) -> str:
    """A sentence's pattern for a part of it, which ends before the next licence."""
    return pattern.replace("^.*spdx", "spdx").replace("$", "(?= spdx|$)").replace(".*version", "((?!licensed under)[^<])*?version")


def _repeated(sentence: Column) -> Column:
    """The sentence with its licences named one by one, however long it is, and those it denies taken out."""
    at = F.regexp_instr(sentence, F.lit(FIRST))
    head, rest = F.substring(sentence, F.lit(1), at - 1), F.substring(sentence, at, F.length(sentence))
    spdx = F.startswith(rest, F.lit("spdx"))
    steps = reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), AGAIN, rest)
    named = F.when(at == 0, sentence).otherwise(F.concat(head, F.when(spdx, F.regexp_replace(rest, *AGAIN_SPDX)).otherwise(steps)))
    return F.regexp_replace(named, DENIED, "denied ")


def _identifiers(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    replaced = lambda c, steps: reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), steps, c)
    words = F.transform(F.split(replaced(F.translate(text, upper, lower), PARAGRAPHS), "\x01"), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    known = F.transform(F.transform(words, _repeated), lambda s: replaced(s, [(_within(p), f"<{n}>") for n, p in SENTENCES]))
    return F.array_join(F.flatten(F.transform(known, lambda s: F.regexp_extract_all(s, F.lit("(<[a-z0-9_]+>)"), F.lit(1)))), "")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, identifiers, licenses: for every row; licences in the order of their first rules, each once.

    Null or empty text, or none known: 0, '' and ''. Repeated rows give repeated results, an empty table none; texts of any
    length are read whole; other columns, of whatever name, are ignored.
    """
    out = docs.select("doc_id", whole().alias("_text"))
    out = out.select("doc_id", F.when(F.col("_text").rlike(HINT), _identifiers(F.col("_text"))).otherwise("").alias("identifiers"))
    out = out.withColumn("n_sentences", F.regexp_count("identifiers", F.lit("<")).cast("long"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("rule")) for n, r in RULES])
    begin = F.struct(F.col("identifiers").alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.when(F.regexp(acc["rest"], x["rule"]), F.concat(acc["found"], F.array(x["name"]))).otherwise(acc["found"])
        return F.struct(F.regexp_replace(acc["rest"], x["rule"], F.lit(" ")).alias("rest"), hit.alias("found"))

    names = F.array(*[F.lit(n) for n in dict.fromkeys(n for n, _ in RULES)])
    licenses = F.aggregate(rules, begin, step, lambda acc: F.array_join(F.filter(names, lambda n: F.array_contains(acc["found"], n)), ","))
    return out.withColumn("licenses", F.when(F.col("n_sentences") > 0, licenses).otherwise("")).select("doc_id", "n_sentences", "identifiers", "licenses")


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "CASE " + " ".join(f"WHEN regexp_matches(s, {quote(p)}) THEN '<{n}>'" for n, p in SENTENCES) + " ELSE '' END"
    steps, last = [], "r0"
    for i, (_, rule) in enumerate(RULES):
        steps.append(f"t{i + 1} AS (SELECT *, regexp_matches(r{i}, {quote(rule)}) AS h{i}, regexp_replace(r{i}, {quote(rule)}, ' ', 'g') AS r{i + 1} FROM t{i})")
        last = f"t{i + 1}"
    names = list(dict.fromkeys(n for n, _ in RULES))
    hit = ", ".join(f"CASE WHEN {' OR '.join(f'h{i}' for i, (m, _) in enumerate(RULES) if m == n)} THEN '{n}' END" for n in names)
    return f"""
WITH cut AS (
  SELECT doc_id, list_transform(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([.!?;])[ \\t\\r]+', E'\\\\1\\n', 'g'), '\\n+'),
    lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))) AS sentences FROM documents
), t0 AS (SELECT doc_id, array_to_string(list_transform(sentences, lambda s: {known}), '') AS r0 FROM cut), {", ".join(steps)}
SELECT doc_id, CAST(length(r0) - length(replace(r0, '<', '')) AS BIGINT) AS n_sentences, r0 AS identifiers, concat_ws(',', {hit}) AS licenses FROM {last}
"""


ORACLE = _oracle()
