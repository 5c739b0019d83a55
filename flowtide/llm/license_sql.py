"""The license scan over whole tables in SQL, with templates and thresholds of its own."""

SQL = r"""
WITH templates(template, label, phrase, tw) AS (VALUES
  (0, 'gpl', true, string_split('gnu general public license', ' ')),
  (1, 'apache', true, string_split('apache license', ' ')),
  (2, 'cc-by', true, string_split('cc by', ' ')),
  (3, 'mit', true, string_split('mit license', ' ')),
  (4, 'gpl', false, string_split('this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation', ' ')),
  (5, 'lgpl', false, string_split('under the terms of the gnu lesser general public license as published by the free software foundation', ' ')),
  (6, 'apache', false, string_split('licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license', ' ')),
  (7, 'mit', false, string_split('permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction', ' ')),
  (8, 'bsd', false, string_split('redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', ' ')),
  (9, 'mpl', false, string_split('this source code form is subject to the terms of the mozilla public license v 2 0', ' ')),
  (10, 'isc', false, string_split('permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted', ' ')),
  (11, 'cc-by', false, string_split('this work is licensed under a creative commons attribution 4 0 international license', ' ')),
  (12, 'unlicense', false, string_split('this is free and unencumbered software released into the public domain', ' ')),
  (13, 'gpl', false, string_split('this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version', ' ')),
  (14, 'lgpl', false, string_split('this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version', ' ')),
  (15, 'apache', false, string_split('licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license', ' ')),
  (16, 'mit', false, string_split('permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software', ' ')),
  (17, 'bsd', false, string_split('redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage', ' ')),
  (18, 'mpl', false, string_split('this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0', ' ')),
  (19, 'isc', false, string_split('permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software', ' ')),
  (20, 'unlicense', false, string_split('this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means', ' '))),
g0 AS (SELECT template, label, phrase, tw, CASE WHEN phrase THEN 2 ELSE 3 END AS k FROM templates),
t0 AS (SELECT template, label, k, tw[i] AS a, tw[i + 1] AS b, CASE WHEN k = 3 THEN tw[i + 2] ELSE '' END AS c, i AS place
       FROM (SELECT *, unnest(range(1, len(tw) - k + 2)) AS i FROM g0)),
owned AS (SELECT k, a, b, c, count(DISTINCT label) = 1 AS own FROM t0 GROUP BY ALL),
t AS (SELECT * FROM t0 JOIN owned USING (k, a, b, c)),
facts AS (SELECT template, count(*) AS places, count(*) FILTER (own) AS owned FROM t GROUP BY template),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
g AS (
  SELECT rid, 2 AS k, w[i] AS a, w[i + 1] AS b, '' AS c, i AS pos FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d)
  UNION ALL
  SELECT rid, 3 AS k, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i AS pos FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
v AS (SELECT rid, template, pos - place AS diagonal, place, pos, k, own FROM g JOIN t USING (k, a, b, c)),
diagonals AS (SELECT DISTINCT rid, template, diagonal FROM v),
starts AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal)
                 > (CASE WHEN phrase THEN 0 ELSE 4 END) THEN 1 ELSE 0 END AS fresh
  FROM diagonals JOIN templates USING (template)
),
copies AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS copy FROM starts),
merged AS (
  SELECT rid, template, label, phrase, len(tw) AS words, copy, count(DISTINCT place) AS votes, count(DISTINCT place) FILTER (own) AS own,
         min(pos) - 1 AS first, max(pos + k) - 1 AS last
  FROM copies JOIN v USING (rid, template, diagonal) GROUP BY ALL
),
spans AS (
  SELECT *, votes / places AS coverage FROM merged JOIN facts USING (template)
  WHERE CASE WHEN phrase THEN votes = places ELSE votes / places >= 0.6 AND own >= 0.5 * owned AND last - first <= words * 1.5 END
),
by_row AS (
  SELECT rid, count(*) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word, max(first) FILTER (phrase) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM spans GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN by_row USING (rid)
"""
