"""SQL that cuts texts into sentences."""

#: s: paper_id, sentence, sentence_no of column c of view v.
SENTENCES = r"""
s0 as (select paper_id, regexp_replace({c}, '(^|[^\p{{L}}\p{{N}}_])(et al|e\.g|i\.e|cf|vs|Fig|Figs|Eq|Eqs|Sec|Secs|Tab|Ref|Refs|Dr|Prof|Mr|Ms|Mrs|St|no|No|vol|Vol|pp|approx|resp|[A-Z])\.(\s)', '\1\2' || chr(2) || '\3', 'g') as t from {v}),
s1 as (select paper_id, string_split(regexp_replace(t, '([.!?])(\s+)([A-Z\[\(\d“"''])', '\1' || chr(1) || '\3', 'g'), chr(1)) as a from s0),
s2 as (select paper_id, list_filter(list_transform(a, lambda x: replace(x, chr(2), '.')), lambda x: trim(x) <> '') as a from s1),
s as (select paper_id, unnest(a) as sentence, generate_subscripts(a, 1) - 1 as sentence_no from s2)"""
