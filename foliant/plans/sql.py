"""Shared SQL fragments: the twins of ``foliant.staging`` used by the check queries."""

TITLE = "array_to_string(list_slice(string_split(split_part(text, chr(10), 1), ' '), 1, 6), ' ')"

PAGES_MD = f"""pages_md AS (
  SELECT d.doc_id AS page_id, d.source AS bucket_id, {TITLE} AS page_title, d.lang,
         d.text AS content_markdown,
         CASE WHEN l.toxic = 1 THEN 'community_theory'
              WHEN l.quality = 0 THEN 'speculation' ELSE 'canon' END AS canon_status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

def _w(i: int) -> str:
    return f"string_split(line, ' ')[{i}]"


_W0 = _w(1)
_W1 = f"coalesce({_w(2)}, 'x')"
_REST = "array_to_string(list_slice(string_split(line, ' '), 2, len(string_split(line, ' '))), ' ')"
_Q = "chr(39)"

WIKI = f"""wiki AS (
  SELECT doc_id AS page_id, {TITLE} AS page_title,
    array_to_string(list_transform(string_split(text, chr(10)), lambda line, n:
      CASE (n - 1) % 12
      WHEN 0 THEN '== ' || {_W0} || ' ' || {_W1} || ' ==' || chr(10) || line
      WHEN 1 THEN repeat({_Q}, 3) || {_W0} || repeat({_Q}, 3) || ' ' || {_REST}
      WHEN 2 THEN '* ' || {_W0} || ': ' || line
      WHEN 3 THEN '[[' || {_W0} || '|' || {_W1} || ']] [[' || {_W1} || '#s]] ' || line
      WHEN 4 THEN '{{{{Quote|' || line || '|' || {_W0} || '}}}}'
      WHEN 5 THEN '=== Acquisition ===' || chr(10) || line
      WHEN 6 THEN '== Lore ==' || chr(10) || line
      WHEN 7 THEN '<!-- ' || {_W0} || ' --><b>' || {_W0} || '</b><br/>' || line || '<ref>n</ref>'
      WHEN 8 THEN ':: ' || line || ' [https://example.org/p ' || {_W0} || ']'
      WHEN 9 THEN '{{{{Speculation|' || {_W0} || '}}}}' || chr(10) || line
      WHEN 10 THEN '{{| class="t"' || chr(10) || '| ' || {_W0} || chr(10) || '|}}' || chr(10) || line
      ELSE chr(10) || repeat({_Q}, 2) || {_W0} || repeat({_Q}, 2) || ' ' || line || ' clip_one.ogg'
      END), chr(10)) AS wikitext
  FROM documents)"""

SECTIONED = f"""sectioned AS (
  SELECT doc_id AS page_id, source AS bucket_id, {TITLE} AS page_title,
    array_to_string(list_transform(string_split(text, chr(10)), lambda line, n:
      CASE (n - 1) % 9
      WHEN 1 THEN '## ' || {_W0} || ' ' || {_W1} || chr(10) || line
      WHEN 4 THEN '### ' || {_W0} || ' ' || {_W1} || chr(10) || line
      WHEN 6 THEN '#### ' || {_W0} || ' ' || {_W1} || chr(10) || 'end.'
      WHEN 8 THEN '## Short' || chr(10) || 'ok.' || chr(10) || chr(10) || line
      ELSE line END), chr(10)) AS content_markdown
  FROM documents)"""

LINES = """lines AS (
  SELECT conv_id AS page_id, turn AS message_order, role AS speaker, role = 'user' AS player_choice,
         text AS message_text FROM conversations)"""

EV = """ev AS (
  SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us FROM events)"""

CHAT = f"""chat AS (
  SELECT doc_id AS page_id, {TITLE} AS page_title,
    array_to_string(list_transform(string_split(text, chr(10)), lambda line, n:
      CASE (n - 1) % 6
      WHEN 0 THEN '> **{{If ' || {_W0} || '}} ' || {_W0} || ':** ' || line
      WHEN 1 THEN '> **{{Continues as above from ' || {_W0} || ' ' || line
      WHEN 2 THEN '> ' || {_W0} || ': ' || line || ' {{Same as below}}'
      WHEN 3 THEN '> > ' || line || ' {{P' || (n - 1) || '}}' || chr(10) || '[Convo. ends]'
      WHEN 4 THEN '> **' || {_W0} || ':** ' || line || ' {{Convo. ends. Jump}}'
      ELSE '## Chapter ' || {_W0} || chr(10) || line END), chr(10)) AS content_markdown
  FROM documents)"""
