"""Licence scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm._common import durable

#: (licence, wording) of the notices that files carry.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]
CUE = r"(?i)licen[sc]|copyright|rights reserved|permission is hereby|permission to use|is hereby granted|redistribution and use|endorse or promote|public domain|free software|terms of the|\bCC[ -]?(?:BY|0)"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: What stands between two paragraphs: ends of lines with nothing but marks between them, so that an empty comment line divides too.
GAP = r"(?:\r\n|[\n\r])[^\p{L}\p{N}]*(?:\r\n|[\n\r])"
#: Numbers of paragraphs begin here, above those of runs of lines.
PARAGRAPH = 1_000_000_000
LEAST = 0.6
LICENCE_FILE = r"(?i)^(?:licen[sc]e|copying|unlicense)(?:[.-].*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def notices(files: DataFrame, least: float = LEAST) -> DataFrame:
    """files (doc_id, text) to (doc_id, licence, score, whole): the best template of each text with one of cosine `least` or more, and whether the notice is half of the text's words or more.

    A passage is a run of lines that each have a cue word, or a whole paragraph with a cue word somewhere and lines without one; all passages of the corpus are the collection that gives inverse document frequencies."""
    spark = files.sparkSession
    lines = files.select("doc_id", F.posexplode(F.split("text", r"\R")).alias("at", "line"), F.size(F.split(F.trim("text"), r"\s+")).alias("n_words")).filter(F.col("line").rlike(CUE))
    run = lines.withColumn("run", F.col("at") - F.row_number().over(_by("doc_id", "at")))
    whole = files.select("doc_id", F.posexplode(F.split("text", GAP)).alias("at", "passage"), F.size(F.split(F.trim("text"), r"\s+")).alias("n_words")).filter(F.col("passage").rlike(CUE) & F.exists(F.split("passage", r"\R"), lambda x: ~x.rlike(CUE)))
    passages = durable(whole.select("doc_id", (F.col("at") + PARAGRAPH).alias("run"), "passage", "n_words").unionByName(run.groupBy("doc_id", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x.line), " ").alias("passage"), F.max("n_words").alias("n_words"))))
    n = passages.count()
    tf = passages.select("doc_id", "run", F.explode(terms(F.col("passage"))).alias("term")).groupBy("doc_id", "run", "term").agg(F.count("*").alias("tf"))
    templates = spark.createDataFrame([(k, licence, wording) for k, (licence, wording) in enumerate(TEMPLATES)], "template int, licence string, wording string")
    template_tf = templates.select("template", "licence", F.explode(terms(F.col("wording"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    w = tf.join(df, "term").select("doc_id", "run", "term", (F.col("tf") * idf).alias("w"))
    tw = template_tf.join(df, "term", "left").select("template", "licence", "term", (F.col("tf") * idf).alias("tw"))
    norm = tw.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("template_norm"))
    own = tw.groupBy("term").agg(F.collect_list(F.struct("template", "licence", "tw")).alias("of"))
    # one row for each term of a passage; terms of no template count in the passage's norm alone
    joined = w.join(own, "term", "left").withColumn("square", F.col("w") * F.col("w"))
    norms = joined.groupBy("doc_id", "run").agg(F.sqrt(F.sum("square")).alias("norm"))
    dot = joined.filter("of is not null").select("doc_id", "run", "w", F.explode("of").alias("o")).groupBy("doc_id", "run", "o.template", "o.licence").agg(F.sum(F.col("w") * F.col("o.tw")).alias("dot"))
    scored = dot.join(F.broadcast(norm), "template").join(norms, ["doc_id", "run"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6)).filter(F.col("score") >= least)
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("licence", "score", "run"), F.struct("score", -F.col("template"), -F.col("run"))).alias("b"))
    return best.select("doc_id", "b.licence", "b.score", F.col("b.run").alias("run")).join(passages, ["doc_id", "run"]).select("doc_id", "licence", "score", (F.size(F.split(F.trim("passage"), r"\s+")) * 2 >= F.col("n_words")).alias("whole"))


def _by(part: str, order: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order)


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """files (doc_id, path, text, ...) to (doc_id, path, licence, score, origin, from_dir), one row for each document.

    A document's own licence ("notice") is the template of greatest TF-IDF cosine to one of its passages, if that is `least` or more. A licence file is one so named (LICENSE, COPYING, ...) or at least half notice, and with a licence; its directory has the licence of its best one. Any other document gets ("inherited") that of the nearest directory above it that has one, by a join of each distinct directory's ancestors; else licence is null and origin "none".

    Ties go to the earlier template, then to runs of lines before paragraphs, then to the earlier passage; between licence files to the lesser doc_id. Null and empty texts have no notice but inherit; documents with a null path don't inherit; rows without doc_id are left out, and rows that repeat one are one document, that of the least path and the least of the texts with a cue word. Paths are divided by "/"; other columns don't matter."""
    base = files.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("path").cast("string").alias("path"), "text")
    places = base.groupBy("doc_id").agg(F.min("path").alias("path")).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    found = durable(notices(durable(base.filter(F.col("text").rlike(CUE)).groupBy("doc_id").agg(F.min("text").alias("text"))), least))
    known = durable(places.join(found, "doc_id", "left"))
    name = F.regexp_extract("path", r"[^/]*$", 0)
    dirs = known.filter(F.col("licence").isNotNull() & F.col("dir").isNotNull() & (F.col("whole") | name.rlike(LICENCE_FILE))).groupBy("dir").agg(F.max_by("licence", F.struct("score", -F.col("doc_id"))).alias("dir_licence")).withColumnRenamed("dir", "from_dir")
    parts = F.split("dir", "/")
    above = known.select("dir").filter("dir is not null").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("from_dir")).distinct()
    nearest = above.join(dirs, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "dir_licence"), F.length("from_dir")).alias("near"))
    all_ = known.join(nearest, "dir", "left")
    mine = F.col("licence").isNotNull()
    return all_.select("doc_id", "path", F.coalesce("licence", "near.dir_licence").alias("licence"), "score", F.when(mine, "notice").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~mine, F.col("near.from_dir")).alias("from_dir"))


#: scan over the files <source>/<lang>/<doc_id>.txt that the documents stand for. Only directories two deep hold files there, so the nearest licence is that of a document's own.
SQL = f"""
WITH templates(template, licence, wording) AS (VALUES {", ".join(f"({k}, '{licence}', '{wording}')" for k, (licence, wording) in enumerate(TEMPLATES))}),
cut AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\f\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls, len(regexp_split_to_array(trim(text), '\\s+')) AS n_words FROM documents WHERE regexp_matches(text, '{CUE}')),
lines AS (SELECT doc_id, n_words, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM cut),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM lines WHERE regexp_matches(line, '{CUE}')),
wholes AS (SELECT doc_id, n_words, unnest(range(len(ps))) AS pos, unnest(ps) AS passage FROM (SELECT doc_id, n_words, regexp_split_to_array(text, '{GAP}') AS ps FROM cut JOIN documents USING (doc_id))),
passages AS (SELECT doc_id, run, string_agg(line, ' ' ORDER BY pos) AS passage, max(n_words) AS n_words FROM runs GROUP BY doc_id, run UNION ALL SELECT doc_id, pos + {PARAGRAPH}, passage, n_words FROM wholes WHERE regexp_matches(passage, '{CUE}') AND len(list_filter(regexp_split_to_array(passage, '\\r\\n|[\\n\\r\\x0b\\f\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: NOT regexp_matches(x, '{CUE}'))) > 0),
n AS (SELECT count(*) AS n FROM passages),
tf AS (SELECT doc_id, run, term, count(*) AS tf FROM (SELECT doc_id, run, unnest(regexp_extract_all(lower(passage), '{TERM}')) AS term FROM passages) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT doc_id, run, tf.term, tf * (ln((n + 1.0) / (df + 1.0)) + 1.0) AS w FROM tf JOIN df USING (term), n),
tw AS (SELECT template, licence, t.term, t.tf * (ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) AS tw FROM (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest(regexp_extract_all(lower(wording), '{TERM}')) AS term FROM templates) GROUP BY ALL) t LEFT JOIN df ON df.term = t.term, n),
tn AS (SELECT template, sqrt(sum(tw * tw)) AS tn FROM tw GROUP BY ALL),
wn AS (SELECT doc_id, run, sqrt(sum(w * w)) AS wn FROM w GROUP BY ALL),
dots AS (SELECT doc_id, run, template, licence, sum(w * tw) AS dot FROM w JOIN tw USING (term) GROUP BY ALL),
scored AS (SELECT *, round(dot / (wn * tn), 6) AS score FROM dots JOIN tn USING (template) JOIN wn USING (doc_id, run)),
best AS (SELECT * FROM scored WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template, run) = 1),
found AS (SELECT doc_id, licence, score, len(regexp_split_to_array(trim(passage), '\\s+')) * 2 >= n_words AS whole FROM best JOIN passages USING (doc_id, run)),
known AS (SELECT d.doc_id, concat_ws('/', d.source, d.lang) AS dir, licence, score, whole FROM documents d LEFT JOIN found USING (doc_id)),
dirs AS (SELECT dir, licence AS dir_licence FROM known WHERE whole QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, doc_id) = 1)
SELECT doc_id, dir || '/' || doc_id || '.txt' AS path, coalesce(licence, dir_licence) AS licence, score, CASE WHEN licence IS NOT NULL THEN 'notice' WHEN dir_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN licence IS NULL AND dir_licence IS NOT NULL THEN dir END AS from_dir
FROM known LEFT JOIN dirs USING (dir)"""
