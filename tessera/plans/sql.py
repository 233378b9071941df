"""The same queries as DuckDB SQL, written independently of the plans, as their check. CHAIN names the steps that several queries share."""

from __future__ import annotations

CHAIN = r"""
slides AS (
  SELECT l.*, 'P-' || lpad(o_custkey::VARCHAR, 7, '0') patient_id, 'P-' || lpad(o_custkey::VARCHAR, 7, '0') || '-T' || o_orderkey sample_id,
    if(o_custkey % 31 = 0, NULL, o_custkey::VARCHAR) mrn, (l_orderkey * 10 + l_linenumber)::VARCHAR image_id, split_part(p_type, ' ', 1) kind, p_size, p_brand, p_type part_type, p_name part_description,
    o_orderpriority cancer_type, o_orderpriority || ' / ' || o_orderstatus cancer_type_detailed, o_orderpriority[1] oncotree_code, split_part(p_type, ' ', -1) primary_site,
    if(l_linenumber % 2 = 0, 'Metastasis', 'Primary') sample_type, if(l_linenumber % 2 = 0, p_brand, NULL) metastatic_site, if(l_suppkey % 5 = 0, NULL, (l_partkey % 100)::VARCHAR) tumor_purity,
    array_to_string(string_split(p_name, ' ')[: (l_suppkey % 3)::INT], ';') oncogenic_mutations, (l_suppkey % 3)::INT num_oncogenic_mutations, round(l_quantity::DOUBLE / 4, 2) cvr_tmb_score, if(l_tax::DOUBLE > 0.06, 'Instable', 'Stable') msi_type, if(l_suppkey % 7 = 0, NULL, l_shipdate::DATE::VARCHAR) AS shipday,
    CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 'LEGACY-' || l_partkey ELSE 'S' || l_suppkey || '/' || (l_partkey % 9 + 1) || '-A' || l_linenumber END block_id,
    if(l_partkey % 19 = 0, NULL, 'A' || l_linenumber) block_label, if(p_size > 25, '40x', '20x') magnification, l_suppkey * 1000 + l_partkey file_size_bytes, 'ACC-' || l_suppkey || '-' || (l_partkey % 50) accession
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
stained AS (
  SELECT *, CASE WHEN kind IN ('PROMO', 'MEDIUM') THEN 'IHC' WHEN kind = 'STANDARD' THEN 'H&E (Initial)' WHEN kind = 'ECONOMY' THEN 'H&E (Other)' WHEN kind = 'LARGE' THEN 'Special' END stain_group,
    CASE WHEN kind = 'SMALL' THEN if(p_size % 3 = 0, 'H&E', 'HE') WHEN kind = 'MEDIUM' AND p_size % 5 = 0 THEN 'Immuno Recut L1' ELSE p_brand END stain_name FROM slides),
inv AS (
  SELECT (l_orderkey * 10 + l_linenumber)::VARCHAR image_id, CASE l_returnflag WHEN 'R' THEN 's3://primary/' WHEN 'A' THEN 's3://secondary/' ELSE 'file:///archive/' END || l_partkey || '-' || l_suppkey || '.svs' AS path FROM lineitem),
best AS (SELECT image_id, (min({'r': CASE WHEN starts_with(path, 's3://primary/') THEN 0 WHEN starts_with(path, 's3://') THEN 1 ELSE 2 END, 'p': path})).p AS path FROM inv GROUP BY image_id),
blockm AS (SELECT * FROM stained WHERE l_linestatus = 'F' AND l_returnflag <> 'N'),
partm AS (
  SELECT * EXCLUDE (sample_id), if(l_partkey % 17 = 0, NULL, sample_id) sample_id, if(l_partkey % 11 = 0, NULL, (l_partkey % 9 + 1)::VARCHAR) part_no, if(l_partkey % 13 = 0, NULL, l_linenumber::VARCHAR) block_no,
    if(l_suppkey % 23 = 0, 'n/a', shipday) AS proc, if(l_partkey % 5 <> 0, NULL, 's3://secondary/url-' || l_partkey) AS url FROM stained WHERE l_linestatus = 'O' AND l_suppkey % 3 <> 0),
seqs AS (
  SELECT sample_id, max(d) sequencing_date FROM (
    SELECT 'P-' || lpad(o_custkey::VARCHAR, 7, '0') || '-T' || o_orderkey sample_id, unnest([
      if(o_orderstatus IN ('F', 'P') AND o_orderkey % 97 <> 0, o_orderdate::DATE, NULL), if(o_orderstatus IN ('O', 'P') AND o_orderkey % 89 <> 0, (o_orderdate::DATE + 1)::DATE, NULL)]) d FROM orders)
  WHERE d IS NOT NULL GROUP BY 1),
pairs AS (SELECT patient_id, sample_id, mrn FROM blockm UNION SELECT patient_id, sample_id, mrn FROM partm WHERE sample_id IS NOT NULL),
refs AS (SELECT patient_id, sample_id reference_sample_id, sequencing_date FROM pairs JOIN seqs USING (sample_id) QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY sequencing_date, sample_id) = 1),
pmap AS (SELECT DISTINCT patient_id, mrn FROM pairs WHERE mrn IS NOT NULL),
procs AS (SELECT accession, max(shipday) AS procday FROM slides WHERE shipday IS NOT NULL AND accession IN (SELECT accession FROM slides WHERE mrn IN (SELECT mrn FROM pmap)) GROUP BY 1),
dates AS (SELECT DISTINCT m.patient_id, s.image_id, try_cast(procday AS DATE) AS d FROM slides s JOIN pmap m ON s.mrn = m.mrn LEFT JOIN procs USING (accession)),
bm AS (
  SELECT DISTINCT 'BLOCK' match_level, b.patient_id, b.sample_id, b.image_id, 'part:' || coalesce(nullif(regexp_extract(block_id, '/([0-9]+)-', 1), ''), 'image:' || b.image_id) part_key, nullif(regexp_extract(block_id, '/([0-9]+)-', 1), '') part_number,
    part_type, part_description, part_description path_dx_title, 'block:' || coalesce(block_id, 'image:' || b.image_id) block_key, block_id block_number, block_label, stain_name, stain_group, magnification, file_size_bytes,
    coalesce(try_cast(shipday AS DATE), d) procedure_date, path slide_path
  FROM blockm b LEFT JOIN best USING (image_id) LEFT JOIN dates ON dates.patient_id = b.patient_id AND dates.image_id = b.image_id),
pm AS (
  SELECT DISTINCT 'PART' match_level, b.patient_id, b.sample_id, b.image_id, 'part:' || coalesce(part_no, 'image:' || b.image_id) part_key, part_no part_number, part_type, part_description, part_description path_dx_title,
    'block:' || coalesce(block_no, block_label, 'image:' || b.image_id) block_key, block_no block_number, block_label, stain_name, stain_group, magnification, file_size_bytes, coalesce(try_cast(proc AS DATE), d) procedure_date, coalesce(path, url) slide_path
  FROM partm b LEFT JOIN best USING (image_id) LEFT JOIN dates ON dates.patient_id = b.patient_id AND dates.image_id = b.image_id
  WHERE b.sample_id IS NULL OR (b.patient_id, b.sample_id, b.image_id) NOT IN (SELECT (patient_id, sample_id, image_id) FROM bm)),
um AS (
  SELECT DISTINCT 'UNMATCHED' match_level, m.patient_id, NULL::VARCHAR sample_id, s.image_id,
    CASE WHEN regexp_matches(block_id, '^.+/[0-9]+-[^/]+$') THEN 'part:unmatched:' || regexp_extract(block_id, '^(.+/[0-9]+)-[^/]+$', 1) WHEN block_id IS NOT NULL THEN 'part:unmatched:block:' || block_id ELSE 'part:unmatched:image:' || s.image_id END part_key,
    nullif(regexp_extract(block_id, '/([0-9]+)-', 1), '') part_number, part_type, part_description, part_description path_dx_title, 'block:' || coalesce(block_id, 'image:' || s.image_id) block_key, block_id block_number, block_label,
    stain_name, stain_group, magnification, file_size_bytes, d procedure_date, path slide_path
  FROM stained s JOIN pmap m ON s.mrn = m.mrn LEFT JOIN best USING (image_id) LEFT JOIN dates ON dates.patient_id = m.patient_id AND dates.image_id = s.image_id
  WHERE (m.patient_id, s.image_id) NOT IN (SELECT (patient_id, image_id) FROM bm UNION ALL SELECT (patient_id, image_id) FROM pm)),
ranked AS (
  SELECT * FROM (SELECT * FROM bm UNION ALL SELECT * FROM pm UNION ALL SELECT * FROM um) QUALIFY row_number() OVER (PARTITION BY patient_id, image_id ORDER BY
    CASE WHEN starts_with(slide_path, 's3://primary/') THEN 0 WHEN starts_with(slide_path, 's3://') THEN 1 ELSE 2 END, list_position(['BLOCK', 'PART', 'UNMATCHED'], match_level), sample_id IS NULL, part_key, block_key,
    sample_id NULLS FIRST, stain_group NULLS FIRST, stain_name NULLS FIRST, part_type NULLS FIRST, part_description NULLS FIRST, part_number NULLS FIRST, block_number NULLS FIRST, block_label NULLS FIRST,
    procedure_date NULLS FIRST, slide_path NULLS FIRST, file_size_bytes NULLS FIRST) = 1),
can AS (
  SELECT 'canonical_slide_associations_v2' association_version, TIMESTAMP '2025-01-01' updated_at, match_level, r.patient_id, sample_id, reference_sample_id, part_key, part_number, NULL::VARCHAR part_designator, part_type, part_description, NULL::VARCHAR subspecialty, path_dx_title,
    block_key, block_number, block_label, image_id, stain_name, stain_group, coalesce(lower(stain_group) IN ('h&e (initial)', 'h&e (other)', 'h&e'), false) OR coalesce(lower(trim(stain_name)) IN ('h&e', 'he'), false) is_hne,
    coalesce(lower(stain_group) = 'ihc', false) is_ihc, magnification, file_size_bytes, coalesce(starts_with(slide_path, 's3://'), false) can_serve_tiles, NULL::VARCHAR barcode, NULL::VARCHAR slide_type,
    lower(match_level) || '::' || part_key || '::' || block_key specimen_key, date_diff('day', sequencing_date, procedure_date)::INT procedure_date_days,
    if(procedure_date IS NOT NULL AND sequencing_date IS NOT NULL, 'Procedure date relative to tumor sequencing', NULL) timepoint_source, slide_path
  FROM ranked r LEFT JOIN refs ON refs.patient_id = r.patient_id),
flags AS (SELECT *, contains(lower(coalesce(stain_group, stain_name, '')), 'h&e') h, contains(lower(coalesce(stain_group, '')), 'ihc') i FROM can WHERE sample_id IS NOT NULL),
summary AS (
  SELECT sample_id, patient_id, max(association_version) association_version, max(updated_at) updated_at, count(DISTINCT image_id) FILTER (WHERE can_serve_tiles AND (h OR i)) servable_slide_count, count(DISTINCT image_id) FILTER (WHERE NOT can_serve_tiles AND h) non_servable_hne_slide_count,
    count(DISTINCT image_id) FILTER (WHERE NOT can_serve_tiles AND i) non_servable_ihc_slide_count, max((can_serve_tiles AND h)::INT) has_hne, max((can_serve_tiles AND i)::INT) has_ihc,
    coalesce(array_to_string(list_sort(list(DISTINCT stain_name) FILTER (WHERE can_serve_tiles AND (h OR i) AND stain_name IS NOT NULL)), ';'), '') stain_types
  FROM flags GROUP BY 1, 2),
wanted AS (SELECT 'P-' || lpad(o_custkey::VARCHAR, 7, '0') || '-T' || o_orderkey sample_id FROM orders),
counts AS (SELECT sample_id, count(*) n_slides, count_if(match_level = 'PART')::BIGINT n_part, count_if(match_level = 'BLOCK')::BIGINT n_block FROM can WHERE sample_id IS NOT NULL GROUP BY 1),
res AS (
  SELECT DISTINCT 'study_' || (substr(patient_id, 3, 7)::INT % 3) study_id, unnest([{'t': 'patient', 'id': patient_id, 'p': NULL, 's': NULL}, {'t': 'sample', 'id': sample_id, 'p': NULL, 's': NULL}, {'t': 'slide', 'id': image_id, 'p': patient_id, 's': slide_path}]) u FROM can),
idx AS (SELECT study_id, u.t resource_type, u.id resource_id, u.p patient_id, u.s source_path FROM res WHERE u.id IS NOT NULL),
reg AS (
  SELECT DISTINCT image_id, if(image_id::BIGINT % 5 = 0, 's3://moved/old.svs', path) source_path, if(image_id::BIGINT % 4 = 0, 'failed', 'success') status, make_timestamp((1700000000 + image_id::BIGINT % 1000) * 1000000) rendered_at FROM inv WHERE image_id::BIGINT % 3 = 0),
reg1 AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY status <> 'success', rendered_at DESC, source_path, status) = 1),
serv AS (SELECT image_id, (min({'r': (NOT starts_with(path, 's3://primary/'))::INT, 'p': path})).p AS path FROM inv WHERE starts_with(path, 's3://') GROUP BY 1),
cand AS (SELECT s.image_id, s.path FROM serv s LEFT JOIN reg1 r USING (image_id) WHERE r.image_id IS NULL OR (status = 'success' AND source_path <> path)),
done AS (SELECT image_id, path source_path, if(image_id::BIGINT % 9 = 0, 'failed', 'success') status, make_timestamp(1800000000000000) rendered_at FROM cand),
rp AS (SELECT DISTINCT patient_id FROM can WHERE slide_path LIKE 's3://%' AND substr(patient_id, 3)::BIGINT IN (SELECT c_custkey FROM customer)),
rel AS (SELECT *, substr(patient_id, 3)::BIGINT % 3 + 1 study, substr(patient_id, 3)::BIGINT patient, split_part(sample_id, '-T', 2)::BIGINT sample, split_part(reference_sample_id, '-T', 2)::BIGINT reference FROM can),
geo0 AS (
  SELECT p_partkey slide_id, (p_size * 1500 + p_partkey % 700 + 100)::BIGINT width, (p_partkey * 37 % 40000 + 90)::BIGINT height, (p_size % 6 + 1)::INT levels FROM part),
geo1 AS (
  SELECT *, ceil(log2(greatest(width, height) / 256.0))::INT max_zoom FROM (SELECT DISTINCT l_partkey slide_id, l_linenumber::INT z, (l_suppkey % 7)::INT x, (l_partkey % 5)::INT y FROM lineitem) JOIN geo0 USING (slide_id)),
geo2 AS (SELECT *, if(z BETWEEN 0 AND max_zoom, 1::BIGINT << (max_zoom - z), NULL) AS downsample FROM geo1),
geo3 AS (SELECT *, x * 256 * downsample AS x0, y * 256 * downsample AS y0, CASE WHEN downsample IS NULL THEN 'out_of_range' WHEN x * 256 * downsample >= width OR y * 256 * downsample >= height THEN 'out_of_bounds' ELSE 'ok' END status FROM geo2),
geo4 AS (SELECT *, if(status = 'ok', least(256 * downsample, width - x0), NULL) source_width, if(status = 'ok', least(256 * downsample, height - y0), NULL) source_height FROM geo3),
geo AS (SELECT *, ceil(source_width / downsample)::BIGINT out_width, ceil(source_height / downsample)::BIGINT out_height FROM geo4),
dec1 AS (SELECT *, if(status = 'ok', least(levels - 1, max_zoom - z), NULL)::INT AS level, if(status = 'ok', 1::BIGINT << least(levels - 1, max_zoom - z), NULL) AS level_downsample FROM geo),
dec2 AS (SELECT *, least(ceil(source_width / level_downsample)::BIGINT, width // level_downsample - x0 // level_downsample) read_width, least(ceil(source_height / level_downsample)::BIGINT, height // level_downsample - y0 // level_downsample) read_height FROM dec1),
tn AS (
  SELECT *, greatest(1, least(width, round_even(width * least(512 / width, 512 / height, 1.0), 0)::BIGINT)) target_width, greatest(1, least(height, round_even(height * least(512 / width, 512 / height, 1.0), 0)::BIGINT)) target_height,
    list_filter(range(0, levels), lambda i: (width >> i) * (height >> i) <= 4000000) safe FROM geo0)
"""


def over(select: str) -> str:
    return f"WITH {CHAIN.rstrip()}\n{select.lstrip()}"


_MATCH = ", ".join("match_level patient_id sample_id image_id part_key part_number part_type part_description path_dx_title block_key block_number block_label stain_name stain_group magnification file_size_bytes procedure_date slide_path".split())

LOAD = """
, snap AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY image_id DESC) pos, 'study_' || (patient % 3) sid FROM rel),
sp AS (SELECT *, min(pos) OVER (PARTITION BY patient_id, sample_id) first_pos FROM snap)"""

ORACLES = {
    "best_path_per_image": over("SELECT * FROM best"),
    "sample_sequencing_date": over("SELECT * FROM seqs"),
    "patient_sample_pairs": over("SELECT * FROM pairs"),
    "patient_reference_sample": over("SELECT * FROM refs"),
    "procedure_dates": over("SELECT accession accession_number, procday procedure_date FROM procs"),
    "slide_procedure_dates": over("SELECT patient_id, image_id, d procedure_date FROM dates"),
    "block_matches": over(f"SELECT {_MATCH} FROM bm"),
    "part_matches": over(f"SELECT {_MATCH} FROM pm"),
    "unmatched_associations": over(f"SELECT {_MATCH} FROM um"),
    "canonical_associations": over("SELECT * FROM can"),
    "sample_summary": over("SELECT * FROM summary"),
    "summary_lookup": over("SELECT * EXCLUDE (association_version, updated_at) FROM summary WHERE sample_id IN (SELECT sample_id FROM wanted)"),
    "live_sample_summary": over(r"""
SELECT s.sample_id, s.patient_id, coalesce(servable_slide_count, 0) servable_slide_count, coalesce(non_servable_hne_slide_count, 0) non_servable_hne_slide_count, coalesce(non_servable_ihc_slide_count, 0) non_servable_ihc_slide_count,
  coalesce(has_hne, 0) has_hne, coalesce(has_ihc, 0) has_ihc, coalesce(stain_types, '') stain_types
FROM (SELECT DISTINCT sample_id, patient_id FROM blockm WHERE sample_id IN (SELECT sample_id FROM wanted)) s
LEFT JOIN (SELECT patient_id, count(DISTINCT image_id) servable_slide_count, max((stain_group IS NOT NULL AND stain_group IN ('H&E (Initial)', 'H&E (Other)'))::INT) has_hne,
    max((stain_group IS NOT NULL AND stain_group = 'IHC' AND NOT starts_with(lower(trim(stain_name)), 'immuno recut') AND NOT contains(lower(stain_name), 'unstained'))::INT) has_ihc, array_to_string(list_sort(list(DISTINCT stain_name)), ';') stain_types
  FROM blockm WHERE image_id IN (SELECT image_id FROM serv) GROUP BY 1) v USING (patient_id)
LEFT JOIN (SELECT m.patient_id, count(DISTINCT image_id) FILTER (WHERE starts_with(stain_group, 'H&E')) non_servable_hne_slide_count, count(DISTINCT image_id) FILTER (WHERE stain_group = 'IHC') non_servable_ihc_slide_count
  FROM stained t JOIN (SELECT DISTINCT patient_id, mrn FROM blockm WHERE mrn IS NOT NULL) m ON m.mrn = t.mrn
  WHERE image_id NOT IN (SELECT image_id FROM serv) AND (stain_group IN ('H&E (Initial)', 'H&E (Other)') OR (stain_group = 'IHC' AND NOT starts_with(lower(trim(stain_name)), 'immuno recut') AND NOT contains(lower(stain_name), 'unstained'))) GROUP BY 1) n USING (patient_id)"""),
    "sample_match_counts": over("SELECT * FROM counts"),
    "patient_slide_listing": over("SELECT image_id, patient_id, sample_id, block_id, block_label, part_type, part_description, part_description path_dx_title, stain_name, stain_group, cancer_type, cancer_type_detailed, oncotree_code, primary_site, sample_type, metastatic_site, tumor_purity, oncogenic_mutations, num_oncogenic_mutations, cvr_tmb_score, msi_type, magnification, file_size_bytes, date_diff('day', sequencing_date, shipday::DATE)::INT slide_timepoint_days, if(sequencing_date IS NOT NULL AND shipday IS NOT NULL, 'Procedure date', NULL) slide_timepoint_source, path slide_path FROM blockm LEFT JOIN best USING (image_id) LEFT JOIN seqs USING (sample_id) WHERE patient_id = 'P-0000007'"),
    "counted_samples": over("SELECT 'P-' || lpad(o_custkey::VARCHAR, 7, '0') || '-T' || o_orderkey sample_id, o_orderstatus status, coalesce(n_slides, 0) n_slides, coalesce(n_part, 0) n_part, coalesce(n_block, 0) n_block FROM orders LEFT JOIN counts ON counts.sample_id = 'P-' || lpad(o_custkey::VARCHAR, 7, '0') || '-T' || o_orderkey"),
    "resource_patients": over("SELECT patient_id, 'WSI_VIEWER' resource_id, '/patient/wsiHESlides?studyId=study&caseId=' || patient_id url FROM rp"),
    "resource_manifest_stats": over("SELECT max(updated_at) updated_at, max(association_version) association_version, count(*) n_rows, count(DISTINCT patient_id) n_patients FROM can WHERE slide_path LIKE 's3://%' AND patient_id IN (SELECT patient_id FROM rp)"),
    "search_patients": over("SELECT patient_id, max(cancer_type) cancer_type, count(*) slide_count FROM blockm WHERE starts_with(patient_id, 'P-00000') GROUP BY 1 ORDER BY 1 LIMIT 8"),
    "search_samples": over("SELECT sample_id, patient_id, max(cancer_type) cancer_type FROM blockm WHERE starts_with(sample_id, 'P-000001') GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 8"),
    "search_slides": over("SELECT image_id, patient_id, stain_name FROM blockm WHERE starts_with(image_id, '12') ORDER BY ALL LIMIT 8"),
    "patient_suggestions": over("SELECT 'patient' AS \"type\", patient_id id, patient_id \"label\", max(cancer_type) || ' · ' || count(*) || ' slides' sublabel FROM blockm WHERE starts_with(patient_id, 'P-00000') GROUP BY patient_id ORDER BY patient_id LIMIT 8"),
    "sample_suggestions": over("SELECT 'sample' AS \"type\", sample_id id, sample_id \"label\", max(cancer_type) sublabel FROM blockm WHERE starts_with(sample_id, 'P-000001') GROUP BY sample_id, patient_id ORDER BY sample_id, patient_id LIMIT 8"),
    "slide_suggestions": over("SELECT 'slide' AS \"type\", image_id id, image_id \"label\", patient_id || ' · ' || stain_name sublabel FROM (SELECT image_id, patient_id, stain_name FROM blockm WHERE starts_with(image_id, '12') ORDER BY ALL LIMIT 8)"),
    "search_routing": r"""
SELECT DISTINCT text, CASE WHEN regexp_matches(trim(text), '(?i)^P-[0-9].*-T') THEN 'sample' WHEN lower(trim(text)) LIKE 'p-%' THEN 'patient' WHEN regexp_matches(trim(text), '^[0-9]') THEN 'slide' END kind
FROM (SELECT unnest(['P-' || lpad(c_custkey::VARCHAR, 7, '0'), 'p-' || lpad(c_custkey::VARCHAR, 7, '0') || '-t1', ' ' || c_custkey || ' ', c_name, 'P-']) AS text FROM customer)""",
    "slide_metadata": over("SELECT image_id, stain_name, stain_group, magnification, file_size_bytes FROM can QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY patient_id) = 1"),
    "slide_bindings": over("SELECT study_id, resource_id image_id, patient_id, source_path FROM idx WHERE resource_type = 'slide' AND resource_id IN (SELECT image_id FROM best)"),
    "preferred_associations": over(f"""
SELECT {_MATCH} FROM (SELECT {_MATCH} FROM bm UNION ALL SELECT {_MATCH} FROM pm UNION ALL SELECT {_MATCH} FROM um) QUALIFY row_number() OVER (PARTITION BY trim(patient_id), trim(image_id) ORDER BY
  CASE WHEN starts_with(slide_path, 's3://primary/') THEN 0 WHEN starts_with(slide_path, 's3://') THEN 1 ELSE 2 END, list_position(['BLOCK', 'PART', 'UNMATCHED'], match_level), sample_id IS NULL, coalesce(sample_id, '~~~~~~~~'),
  if(regexp_full_match(part_number, '[0-9]+'), lpad(part_number, 8, '0'), '~~~~~~~~'),
  coalesce(nullif(trim(block_number), ''), nullif(regexp_extract(trim(block_label), '^([0-9]+)', 1), ''), nullif(trim(block_label), ''), '~~~~~~~~'),
  coalesce(stain_group, '~~~~~~~~'), coalesce(stain_name, '~~~~~~~~'), part_description IS NULL, part_description, procedure_date IS NULL, image_id, part_key NULLS FIRST, block_key NULLS FIRST, part_type NULLS FIRST, path_dx_title NULLS FIRST,
  block_label NULLS FIRST, magnification NULLS FIRST, file_size_bytes NULLS FIRST, procedure_date NULLS FIRST, slide_path NULLS FIRST, part_number NULLS FIRST, block_number NULLS FIRST) = 1"""),
    "candidate_slices": over("SELECT image_id, path, ((row_number() OVER (ORDER BY image_id) - 1) % 7)::INT shard FROM cand"),
    "publish_counts": over("SELECT count_if(status = 'success')::BIGINT success_count, count_if(status <> 'success')::BIGINT failure_count, count(*) record_count FROM reg"),
    "thumbnail_responses": over("""
, ask AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber)::VARCHAR image_id, if(l_returnflag <> 'N', 'study_' || l_suppkey, NULL) study, (l_quantity * 50 - 60)::INT w, l_linenumber * 400 - 500 h FROM lineitem),
man AS (SELECT s.image_id FROM serv s JOIN reg1 r ON r.image_id = s.image_id AND source_path = path WHERE status = 'success'),
ans AS (SELECT image_id, greatest(1, least(w, 2048))::INT width, greatest(1, least(h, 2048))::INT height, study, image_id IN (SELECT image_id FROM man) AS has FROM ask)
SELECT image_id, width, height, if(has, 'ok', 'placeholder') status, CASE WHEN NOT has THEN 'missing' WHEN width >= 512 AND height >= 512 THEN 'master' ELSE 'resized' END reason, if(has, NULL, 45)::INT ttl,
  'thumbnail:' || coalesce(study || ':', '') || image_id || ':' || width || ':' || height cache_key FROM ans""").replace("\n\n,", "\n,"),
    "slide_addresses": over("SELECT DISTINCT image_id, path, if(starts_with(path, 's3://'), split_part(path, '/', 3), NULL) bucket, if(starts_with(path, 's3://'), split_part(path, '/', 4), NULL) object_key, 's3://primary/thumbnails/masters/' || image_id || '.jpg' artifact_uri FROM inv"),
    "slide_properties": """
SELECT p_partkey slide_id, if(p_partkey % 29 = 0, 0.0, ('0.' || (p_size + 10))::DOUBLE)::DOUBLE mpp_x, if(p_partkey % 29 = 0 OR p_size % 7 = 0, 0.0, 0.25)::DOUBLE mpp_y, if(p_partkey % 29 = 0 OR p_size % 2 <> 0, '', p_brand) vendor,
  if(p_partkey % 29 = 0 OR p_partkey % 5 = 0, NULL, p_size % 4 * 10 + 10)::BIGINT objective_power FROM part""",
    "token_decisions": """
SELECT o_orderkey token_id, CASE WHEN o_orderkey % 41 = 0 THEN 'algorithm' WHEN o_orderstatus = 'P' THEN 'audience' WHEN o_orderkey % 37 = 0 THEN 'subject' WHEN o_orderkey % 31 = 0 THEN 'study' WHEN o_orderkey % 23 = 0 THEN 'version'
  WHEN day + o_custkey * 3000000 - 1000 <= 1000000000 THEN 'expired' WHEN day > 1000000060 THEN 'issued' WHEN o_custkey * 3000000 - 1000 <= 0 OR o_custkey * 3000000 - 1000 > 300000000 THEN 'lifetime' END refusal
FROM (SELECT *, epoch(o_orderdate)::BIGINT AS day FROM orders)""",
    "resource_index": over("SELECT * FROM idx"),
    "stored_suggestions": over("SELECT DISTINCT resource_id FROM idx WHERE study_id = 'study_1' AND resource_type = 'patient' AND starts_with(lower(resource_id), 'p-000') ORDER BY resource_id LIMIT 8"),
    "requested_suggestions": over("""
SELECT study_id, resource_type, text, row_number() OVER (PARTITION BY study_id, text ORDER BY resource_id)::INT AS "rank", resource_id
FROM (SELECT DISTINCT study_id, resource_type, resource_id FROM idx WHERE resource_type = 'patient') i
JOIN (SELECT DISTINCT 'p-' || left(lpad(c_custkey::VARCHAR, 7, '0'), 5) AS text FROM customer) q ON starts_with(lower(resource_id), text)
QUALIFY "rank" <= 8"""),
    "index_suggestions": over("SELECT DISTINCT resource_id FROM idx WHERE study_id = 'study_1' AND resource_type = 'slide' AND starts_with(lower(resource_id), '1') ORDER BY lower(resource_id), resource_id LIMIT 8"),
    "index_membership": over("SELECT p.study_id, 'patient' resource_type, p.patient_id resource_id FROM (SELECT 'study_' || c_custkey % 3 study_id, 'P-' || lpad(c_custkey::VARCHAR, 7, '0') patient_id FROM customer) p WHERE EXISTS (SELECT 1 FROM idx WHERE idx.study_id = p.study_id AND resource_type = 'patient' AND resource_id = p.patient_id)"),
    "index_merge": over("SELECT study_id, resource_type, resource_id, patient_id, source_path FROM idx WHERE study_id <> 'study_1' UNION ALL SELECT study_id, resource_type, resource_id, patient_id, source_path FROM idx WHERE study_id = 'study_1' AND resource_type = 'slide'"),
    "registry_best": over("SELECT * FROM reg1"),
    "thumbnail_candidates": over("SELECT * FROM cand"),
    "thumbnail_retry": over("SELECT * FROM serv WHERE image_id IN (SELECT image_id FROM reg1 WHERE status <> 'success')"),
    "thumbnail_shards": over("SELECT image_id, path, ((row_number() OVER (ORDER BY image_id) - 1) // (SELECT ceil(count(*) / least(480, ceil(count(*) / 2000)))::BIGINT FROM cand))::INT shard FROM cand"),
    "streamed_registry": over("SELECT * FROM done UNION ALL SELECT * FROM reg1 WHERE image_id NOT IN (SELECT image_id FROM done)"),
    "registry_upsert": over("SELECT * FROM done UNION ALL SELECT * FROM reg1 WHERE image_id NOT IN (SELECT image_id FROM done)"),
    "thumbnail_manifest": over("SELECT s.image_id, path source_uri, 'thumbnails/' || s.image_id || '.jpg' uri FROM serv s JOIN reg1 r ON r.image_id = s.image_id AND source_path = path WHERE status = 'success'"),
    "release_part": over("SELECT study cancer_study_id, 'release-1' release_id, patient patient_internal_id, part_key, part_number, part_type, part_description, path_dx_title FROM rel QUALIFY row_number() OVER (PARTITION BY study, patient, part_key ORDER BY image_id) = 1"),
    "release_block": over("SELECT study cancer_study_id, 'release-1' release_id, patient patient_internal_id, part_key, block_key, block_number, block_label FROM rel QUALIFY row_number() OVER (PARTITION BY patient, part_key, block_key ORDER BY image_id) = 1"),
    "release_slide": over("SELECT study cancer_study_id, 'release-1' release_id, image_id, stain_name, stain_group, is_hne, is_ihc, magnification, file_size_bytes, can_serve_tiles FROM rel QUALIFY row_number() OVER (PARTITION BY study, image_id ORDER BY patient_id) = 1"),
    "release_placement": over("SELECT study cancer_study_id, 'release-1' release_id, image_id, patient patient_internal_id, sample sample_internal_id, part_key, block_key, match_level, specimen_key, procedure_date_days, timepoint_source FROM rel"),
    "release_patient": over("SELECT study cancer_study_id, patient patient_internal_id, max(reference) reference_sample_internal_id, 'release-1' release_id FROM rel GROUP BY 1, 2"),
    "release_violations": over(r"""
SELECT unnest(['no_image', 'bad_part_key', 'bad_block_key', 'bad_level', 'no_specimen', 'servable_without_path', 'unmatched_with_sample', 'matched_without_sample', 'several_references', 'image_of_several_patients', 'unknown_patient', 'unknown_sample']) AS "rule",
  unnest([count_if(trim(image_id) = ''), count_if(trim(part_key) = '' OR contains(part_key, '?')), count_if(trim(block_key) = '' OR contains(block_key, '?')), count_if(match_level NOT IN ('BLOCK', 'PART', 'UNMATCHED')), count_if(trim(specimen_key) = ''),
    count_if(can_serve_tiles AND NOT coalesce(starts_with(slide_path, 's3://'), false)), count_if(match_level = 'UNMATCHED' AND sample IS NOT NULL), count_if(match_level <> 'UNMATCHED' AND sample IS NULL),
    (SELECT count(*) FROM (SELECT patient FROM rel GROUP BY 1 HAVING count(DISTINCT reference) > 1)), (SELECT count(*) FROM (SELECT study, image_id FROM rel GROUP BY 1, 2 HAVING count(DISTINCT patient) > 1)),
    (SELECT count(DISTINCT patient) FROM rel WHERE patient NOT IN (SELECT c_custkey FROM customer)), (SELECT count(DISTINCT sample) FROM rel WHERE sample NOT IN (SELECT o_orderkey FROM orders))])::BIGINT n FROM rel"""),
    "loaded_part": over(LOAD + " SELECT study::BIGINT cancer_study_id, patient + 1000000 patient_internal_id, part_key, part_number, part_designator, part_type, part_description, subspecialty, path_dx_title FROM sp QUALIFY row_number() OVER (PARTITION BY patient_id, part_key ORDER BY first_pos, pos) = 1"),
    "loaded_block": over(LOAD + " SELECT study::BIGINT cancer_study_id, patient + 1000000 patient_internal_id, part_key, block_key, block_number, block_label FROM sp QUALIFY row_number() OVER (PARTITION BY patient_id, part_key, block_key ORDER BY first_pos, pos) = 1"),
    "loaded_slide": over(LOAD + " SELECT study::BIGINT cancer_study_id, patient + 1000000 patient_internal_id, image_id, stain_name, stain_group, is_hne, is_ihc, magnification, file_size_bytes, can_serve_tiles, barcode, slide_type FROM sp"),
    "loaded_placement": over(LOAD + " SELECT study::BIGINT cancer_study_id, patient + 1000000 patient_internal_id, image_id, part_key, block_key, sample + 5000000 sample_internal_id, match_level, specimen_key, procedure_date_days, timepoint_source FROM sp"),
    "loaded_patient": over(LOAD + " SELECT study::BIGINT cancer_study_id, patient + 1000000 patient_internal_id, max(reference) + 5000000 reference_sample_internal_id FROM sp GROUP BY 1, 2"),
    "load_violations": over(LOAD + r"""
, wanted_s AS (SELECT patient, sample FROM sp WHERE sample IS NOT NULL UNION SELECT patient, reference FROM sp WHERE reference IS NOT NULL),
dup AS (SELECT count(*) k FROM sp GROUP BY patient_id, image_id)
SELECT unnest(['no_image', 'bad_part_key', 'bad_block_key', 'bad_level', 'no_specimen', 'bad_boolean', 'servable_without_path', 'unmatched_with_sample', 'matched_without_sample', 'duplicate_association', 'conflicting_slide', 'conflicting_placement',
  'association_of_other_sample', 'conflicting_binding', 'several_references', 'unknown_patient', 'unknown_sample', 'ambiguous_sample']) AS "rule",
 unnest([count_if(image_id IS NULL), count_if(coalesce(trim(part_key), '') = '' OR contains(part_key, '?')), count_if(coalesce(trim(block_key), '') = '' OR contains(block_key, '?')), count_if(match_level NOT IN ('BLOCK', 'PART', 'UNMATCHED')), count_if(coalesce(trim(specimen_key), '') = ''),
  count_if(can_serve_tiles IS NULL), count_if(can_serve_tiles AND NOT coalesce(starts_with(slide_path, 's3://'), false)), count_if(match_level = 'UNMATCHED' AND sample_id IS NOT NULL), count_if(match_level <> 'UNMATCHED' AND sample_id IS NULL),
  (SELECT count_if(k > 1) FROM dup), 0, 0, 0, (SELECT count(*) FROM (SELECT 1 FROM sp GROUP BY sid, image_id HAVING count(DISTINCT patient_id || coalesce(slide_path, '')) > 1)),
  (SELECT count(*) FROM (SELECT 1 FROM sp GROUP BY patient_id HAVING count(DISTINCT reference) > 1)), (SELECT count(DISTINCT patient) FROM sp WHERE patient NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 29 <> 0)),
  (SELECT count(*) FROM wanted_s WHERE (patient, sample) NOT IN (SELECT (o_custkey, o_orderkey) FROM orders WHERE o_orderkey % 31 <> 0)),
  (SELECT count(*) FROM wanted_s WHERE (patient, sample) IN (SELECT (o_custkey, o_orderkey) FROM orders WHERE o_orderkey % 31 <> 0 AND (o_orderkey + 5000000) % 37 = 0))])::BIGINT n FROM sp"""),
    "rate_limit_admissions": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rn FROM events),
r AS (SELECT event_id, user_id, rn, true admitted, [t] log FROM e WHERE rn = 1
  UNION ALL SELECT e.event_id, e.user_id, e.rn, len(list_filter(r.log, lambda x: x > e.t - 60000000)) < 2,
    CASE WHEN len(list_filter(r.log, lambda x: x > e.t - 60000000)) < 2 THEN list_append(list_filter(r.log, lambda x: x > e.t - 60000000), e.t) ELSE list_filter(r.log, lambda x: x > e.t - 60000000) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, user_id, admitted FROM r""",
    "timeline_events": over(r"""
, ev0 AS (SELECT *, CASE WHEN is_ihc THEN 'IHC' WHEN is_hne THEN 'H&E' END subtype, coalesce(nullif(trim(block_number), ''), coalesce(nullif(regexp_extract(trim(block_label), '^(\d+)', 1), ''), trim(coalesce(block_label, '')))) bl,
  if(coalesce(trim(block_number), '') <> '', try_cast(part_number AS INT), NULL) pt, coalesce(nullif(trim(coalesce(block_label, '')), ''), NULL) lb FROM can WHERE procedure_date_days IS NOT NULL),
ev AS (SELECT *, if(match_level = 'UNMATCHED', 'Unmatched', match_level) mt, coalesce(nullif(sample_id, ''), if(match_level = 'UNMATCHED', 'Unmatched', '')) sd,
  if(pt IS NOT NULL, 'Part ' || pt, coalesce(nullif(trim(part_description), ''), 'Specimen')) || if(match_level = 'BLOCK' AND coalesce(lb, nullif(bl, '')) IS NOT NULL, ' / Block ' || coalesce(lb, nullif(bl, '')), '') sp FROM ev0 WHERE subtype IS NOT NULL)
SELECT patient_id PATIENT_ID, procedure_date_days::VARCHAR START_DATE, '' STOP_DATE, 'PATHOLOGY SLIDES' EVENT_TYPE, sd SAMPLE_ID, subtype SUBTYPE, mt MATCH_LEVEL, sp SPECIMEN,
  count(DISTINCT image_id) FILTER (WHERE can_serve_tiles)::VARCHAR IMAGE_COUNT, count(DISTINCT image_id) FILTER (WHERE NOT can_serve_tiles)::VARCHAR NON_SERVABLE_IMAGE_COUNT, count(DISTINCT image_id)::VARCHAR TOTAL_IMAGE_COUNT,
  coalesce(array_to_string(list_sort(list(DISTINCT timepoint_source) FILTER (WHERE timepoint_source IS NOT NULL)), ', '), '') TIMEPOINT_SOURCE,
  if(can_serve_tiles, '/patient/wsiHESlides?studyId=study&caseId=' || url_encode(patient_id) || '&stainFilter=' || if(subtype = 'H&E', 'hne', 'ihc') || '&matchLevel=' || mt || '&specimenKey=' || replace(url_encode(min(specimen_key)), '%20', '+') || if(sd IN ('', 'Unmatched'), '', '&sampleId=' || url_encode(sd)), '') LINKOUT
FROM ev GROUP BY patient_id, procedure_date_days, sd, mt, sp, if(can_serve_tiles, specimen_key, sp), subtype, can_serve_tiles""").replace("\n\n,", "\n,"),
    "stain_classifier_matrix": over(r"""
SELECT DISTINCT stain_group, stain_name, coalesce(lower(stain_group) IN ('h&e (initial)', 'h&e (other)', 'h&e'), false) OR lower(trim(stain_name)) IN ('h&e', 'he') canonical_hne, coalesce(lower(stain_group) = 'ihc', false) canonical_ihc,
  coalesce(lower(stain_group) IN ('h&e (initial)', 'h&e (other)', 'h&e'), false) OR lower(trim(regexp_replace(stain_name, '\s+', ' ', 'g'))) IN ('h&e', 'he') collapsed_hne,
  CASE WHEN lower(stain_group) = 'ihc' THEN 'IHC' WHEN coalesce(lower(stain_group) IN ('h&e (initial)', 'h&e (other)', 'h&e'), false) OR lower(stain_name) IN ('h&e', 'he') THEN 'H&E' END subtype,
  contains(lower(coalesce(stain_group, stain_name, '')), 'h&e') substring_hne, contains(lower(coalesce(stain_group, '')), 'ihc') substring_ihc, coalesce(stain_group IN ('H&E (Initial)', 'H&E (Other)'), false) diagnostic_hne,
  coalesce(stain_group = 'IHC', false) AND NOT starts_with(lower(trim(stain_name)), 'immuno recut') AND NOT contains(lower(stain_name), 'unstained') diagnostic_ihc FROM stained"""),
    "block_field_derivation": over(r"""
SELECT DISTINCT block_id, block_label, try_cast(nullif(regexp_extract(block_id, '/(\d+)-([^/]+)$', 1), '') AS INT) part,
  if(coalesce(regexp_matches(block_id, '/(\d+)-([^/]+)$'), false), coalesce(nullif(regexp_extract(regexp_extract(block_id, '/(\d+)-([^/]+)$', 2), '^(\d+)', 1), ''), regexp_extract(block_id, '/(\d+)-([^/]+)$', 2)), coalesce(nullif(regexp_extract(block_label, '^(\d+)', 1), ''), block_label, '')) AS "block",
  if(coalesce(regexp_matches(block_id, '/(\d+)-([^/]+)$'), false), coalesce(block_label, regexp_extract(block_id, '/(\d+)-([^/]+)$', 2)), block_label) AS "label" FROM stained"""),
    "tile_geometry": over("SELECT * FROM geo"),
    "decode_plan": over("SELECT * EXCLUDE (status), if(status = 'ok', if(read_width <= 0 OR read_height <= 0, 0, read_width * read_height), NULL)::BIGINT pixels, CASE WHEN status <> 'ok' THEN status WHEN read_width <= 0 OR read_height <= 0 THEN 'blank' WHEN read_width * read_height > 150000 THEN 'too_large' ELSE 'ok' END status FROM dec2"),
    "thumbnail_plan": over("SELECT * EXCLUDE (lv), lv::INT AS level, if(lv IS NULL, 'no_safe_level', 'ok') status, width >> lv read_width, height >> lv read_height FROM (SELECT * EXCLUDE (safe), coalesce(list_max(list_filter(safe, lambda i: (width >> i) >= target_width AND (height >> i) >= target_height)), list_min(safe)) lv FROM tn)"),
    "latency_percentiles": "SELECT event_type, count(value) n, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.95) p95, quantile_disc(value, 0.99) p99, max(value) most, round(avg(value), 6) mean FROM events GROUP BY 1",
    "metric_histogram": "SELECT event_type, b.le, count_if(value <= b.x)::BIGINT n FROM events, (SELECT unnest([{'le': '1.0', 'x': 1.0::DOUBLE}, {'le': '5.0', 'x': 5.0}, {'le': '10.0', 'x': 10.0}, {'le': '25.0', 'x': 25.0}, {'le': '50.0', 'x': 50.0}, {'le': '100.0', 'x': 100.0}, {'le': '+Inf', 'x': 'inf'::DOUBLE}]) b) GROUP BY 1, 2",
    "cache_prune_plan": """SELECT node, path, size FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY node ORDER BY mtime, size, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) gone FROM
  (SELECT *, sum(size) OVER (PARTITION BY node) total FROM (SELECT (p_partkey % 16)::INT node, '/cache/' || p_partkey AS path, p_size::BIGINT mtime, p_partkey * 7919 % 1000 + 1 AS size, p_partkey % 17 = 0 locked FROM part)) WHERE NOT locked AND total > floor(total * 0.6))
  WHERE total - gone > floor(floor(total * 0.6) * 0.8)""",
    "decode_plan_by_levels": over(r"""
, lv AS (SELECT *, list_transform(range(0, levels), lambda i: if(i = 0, 1.0::DOUBLE, pow(slide_id % 3 + 2, i) + if(slide_id % 5 = 0, 0.25, 0))) ds FROM geo),
b AS (SELECT *, if(status = 'ok', coalesce(list_max(list_filter(range(0, levels), lambda i: ds[i + 1] <= downsample)), 0), NULL)::INT AS level FROM lv),
d AS (SELECT *, ds[level + 1] level_downsample FROM b),
q AS (SELECT * EXCLUDE (ds), least(ceil(source_width / level_downsample), floor(width / level_downsample) - floor(x0 / level_downsample))::BIGINT read_width, least(ceil(source_height / level_downsample), floor(height / level_downsample) - floor(y0 / level_downsample))::BIGINT read_height FROM d)
SELECT * EXCLUDE (status), if(read_width <= 0 OR read_height <= 0, 0, read_width * read_height)::BIGINT pixels, CASE WHEN status <> 'ok' THEN status WHEN read_width <= 0 OR read_height <= 0 THEN 'blank' WHEN read_width * read_height > 150000 THEN 'too_large' ELSE 'ok' END status FROM q""").replace("\n\n,", "\n,"),
    "published_summary": over("SELECT * FROM summary"),
    "study_folders": over("""SELECT CASE patient % 3 WHEN 0 THEN 'stated_0' WHEN 1 THEN 'stated_1' ELSE 'study_2' END study_id, count(DISTINCT sample_id) n_samples, count(*) n_slides
FROM rel WHERE sample_id IS NOT NULL GROUP BY 1"""),
    "candidate_file": over("SELECT * FROM cand"),
    "index_file": over("SELECT * FROM idx"),
    "snapshot_file": over("SELECT 'study_' || substr(patient_id, 3, 7)::INT % 3 study_id, patient_id, image_id, sample_id, part_key, block_key, can_serve_tiles, procedure_date_days, file_size_bytes FROM can"),
    "snapshot_of_study": over("SELECT 'study_1' study_id, patient_id, image_id, sample_id, part_key, block_key, can_serve_tiles, procedure_date_days, file_size_bytes FROM can WHERE substr(patient_id, 3, 7)::INT % 3 = 1"),
    "result_lines": over("SELECT image_id, source_path, status FROM reg WHERE image_id::BIGINT % 7 <> 0 AND image_id::BIGINT % 11 <> 0"),
    "manifest_file": over("""SELECT s.image_id, 'thumbnails/' || s.image_id || '.jpg' uri, greatest(1, if(s.image_id::BIGINT % 3 = 0, 256, s.image_id::BIGINT % 2 * 700))::INT width, 300 height,
  if(s.image_id::BIGINT % 4 = 0, 'image/png', 'image/jpeg') content_type, path source_uri FROM serv s JOIN reg1 r ON r.image_id = s.image_id AND source_path = path WHERE status = 'success' AND s.image_id::BIGINT % 5 <> 0"""),
    "clinical_patients": "SELECT 'P-' || lpad(c_custkey::VARCHAR, 7, '0') \"PATIENT_ID\" FROM customer WHERE c_custkey % 17 <> 0",
    "positional_patients": "SELECT if(c_custkey % 17 = 0, '', 'P-' || lpad(c_custkey::VARCHAR, 7, '0')) id FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 13 = 0)",
    "pruned_clinical": "SELECT if(c_custkey % 17 = 0, NULL, 'P-' || lpad(c_custkey::VARCHAR, 7, '0')) \"PATIENT_ID\", c_name \"NAME\" FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 13 = 0)",
    "resource_file": over("SELECT patient_id \"PATIENT_ID\", 'WSI_VIEWER' \"RESOURCE_ID\", '/patient/wsiHESlides?studyId=study&caseId=' || patient_id \"URL\" FROM rp WHERE substr(patient_id, 3)::BIGINT % 17 <> 0"),
    "statement_rows": over("SELECT image_id, stain_name, magnification FROM stained WHERE magnification = '40x' AND stain_group IN ('IHC', 'H&E (Other)')"),
    "coerced_values": "SELECT l_orderkey, l_linenumber, l_linenumber IN (1, 3) flag, if(l_partkey % 3 = 0, l_partkey, NULL)::BIGINT AS number, l_quantity::DECIMAL(12, 2)::DOUBLE quantity FROM lineitem",
}
ORACLES["stored_release"] = ORACLES["catalog_release"] = ORACLES["loaded_part"]
ORACLES["published_timeline"] = ORACLES["timeline_events"]
ORACLES["published_resources"] = ORACLES["resource_index"]
