"""Scalar functions of the study's identifiers, labels and texts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists of diagnosis classes, tried in this order.
DIAGNOSIS = (
    ("malignant", ("invasive", "carcinoma", "malignant", "adenocarcinoma", "squamous", "tumor", "tumour", "cancer")),
    ("benign", ("benign", "fibroadenoma", "fibrocystic", "lipoma")),
    ("pre-malignant", ("hyperplasia", "atypia", "dysplasia", "cin")),
)
# Anatomical sites of case prefixes, in the order of preference.
SITES = {
    "BP": ("Breast",), "BN": ("Breast",), "CP": ("Cervix Uteri",), "CN": ("Cervix Uteri",), "RP": ("Colon",), "RN": ("Colon",),
    "TP": ("Head and Neck", "Oral Cavity", "Oropharynx"), "TN": ("Head and Neck", "Oral Cavity", "Oropharynx"),
}
# The one site of a prefix where a single one is asked for, if it is not the first above.
ONE_SITE = {"TP": "Oral Cavity", "TN": "Oral Cavity"}
# Public buckets of programmes; the first is the fallback.
BUCKETS = {
    "TCGA": "gdc-tcga-phs000178-open", "HCM": "gdc-hcmi-open", "CPTAC": "gdc-cptac-phs001287-open", "TARGET": "gdc-target-phs000218-open", "CGCI": "gdc-cgci-phs000235-open",
}
# File types of slides.
SLIDE_EXTENSIONS = ("svs", "ndpi", "mrxs", "tif", "tiff", "scn", "vms", "vmu", "bif", "qptiff")
# The one number that drives a perturbation at mild, moderate and severe; others have several.
PARAMETERS = {
    1: (0.10, 0.25, 0.40), 3: (0.7, 1.0, 1.3), 4: (10, 30, 60), 5: (0.10, 0.25, 0.40), 8: (5, 15, 30), 9: (0.01, 0.03, 0.05), 10: (80, 50, 20),
    11: (90, 180, 270), 12: (0.8, 1.2, 1.5), 14: (2, 4, 8), 15: (1.0, 2.0, 4.0), 16: (0.5, 0.25, 0.05), 17: (0.7, 1.0, 1.3), 18: (0.7, 1.0, 1.3),
}
# Families of models.
FAMILIES = {"uni": "dinov2", "gigapath_tile": "dinov2", "conch": "clip_cocacontrastive", "quilt_llava": "clip"}


def _lookup(table: dict, key: Column) -> Column:
    """A table of a few literals by key; null for others."""
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v))]), key)


def site_of_prefix(case_id: Column) -> Column:
    """All sites that a case's two leading letters stand for; null for other prefixes."""
    return _lookup(SITES, F.upper(F.substring(case_id, 1, 2)))


def one_site_of_prefix(case_id: Column) -> Column:
    prefix = F.upper(F.substring(case_id, 1, 2))
    return F.coalesce(_lookup(ONE_SITE, prefix), F.get(site_of_prefix(case_id), F.lit(0)))


def bucket_of(program: Column) -> Column:
    return F.coalesce(_lookup(BUCKETS, F.upper(F.split_part(program, F.lit("-"), F.lit(1)))), F.lit(BUCKETS["TCGA"]))


def has_extension(name: Column, extensions=SLIDE_EXTENSIONS) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(*extensions)


def cell_label(perturbation_id: Column, severity: Column, *names: Column) -> Column:
    """``model__p03__sev`` or ``a__b__p03__sev``."""
    return F.concat_ws("__", *names, F.format_string("p%02d", perturbation_id), severity)


def numbered_name(number: Column, name: Column) -> Column:
    return F.format_string("%02d. %s", number, name)


def input_path(root: str, case_id: Column, file_id: Column, file_name: Column) -> Column:
    """Own slides lie flat by case; controls in a folder by file id."""
    return F.when(file_id.isNull(), F.concat(F.lit(f"{root}/"), case_id, F.lit(".svs"))).otherwise(F.concat_ws("/", F.lit(root), file_id, file_name))


def output_path(root: str, case_id: Column, file_id: Column) -> Column:
    return F.concat(F.lit(f"{root}/"), F.coalesce(file_id, case_id), F.lit(".tiff"))


def sex_code(text: Column) -> Column:
    """``male`` of what begins with M, ``female`` of other text, null of none."""
    bare = F.upper(F.trim(text))
    return F.when(bare.startswith("M"), "male").when(F.length(bare) > 0, "female")


def series_sex(text: Column) -> Column:
    return F.upper(F.substring(sex_code(text), 1, 1))


def megabytes(size: Column) -> Column:
    return F.round(size / (1024.0 * 1024.0), 2)


def utc_iso(moment: Column) -> Column:
    """ISO 8601 of a moment, in a session whose time zone is UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def nested_get(json: Column, path: str, default) -> Column:
    """A value inside JSON text, or the default where any level is missing or null."""
    return F.coalesce(F.get_json_object(json, f"$.{path}"), F.lit(default))


def param_of(perturbation_id: Column, severity: Column) -> Column:
    """The perturbation's parameter at the severity as a number to plot; null where it has several."""
    values = _lookup({k: tuple(map(float, v)) for k, v in PARAMETERS.items()}, perturbation_id)
    return F.get(values, F.when(severity == "mild", 0).when(severity == "moderate", 1).when(severity == "severe", 2))


def ready(status: Column, url: Column) -> Column:
    """Rows that can be fetched: matched, with a secure address."""
    return F.coalesce((F.upper(F.trim(status)) == "MATCHED") & url.startswith("https://"), F.lit(False))


def classify_keywords(text: Column, rules=DIAGNOSIS) -> Column:
    """The first class with any of its keywords in the lower-cased text; null: unknown, none: other."""
    out = F.when(text.isNull(), "unknown")
    for name, keywords in rules:
        out = out.when(F.lower(text).rlike("|".join(keywords)), name)
    return out.otherwise("other")


def tissue_prefix(identifier: Column) -> Column:
    return F.when(F.contains(identifier, F.lit("-")), F.split_part(identifier, F.lit("-"), F.lit(1))).otherwise("")


def cohort_of(sample_id: Column) -> Column:
    return F.when(sample_id.startswith("ACC_"), "ACC").otherwise("GDC")


def make_key(perturbation_id: Column, severity: Column, sample_id: Column) -> Column:
    return F.when(perturbation_id.isNull(), F.concat(F.lit("baseline__"), sample_id)).otherwise(F.format_string("p%02d__%s__%s", perturbation_id, severity, sample_id))


def held_out_key(condition: Column, sample_id: Column) -> Column:
    """``condition__id``, as of tiles under conditions outside the battery."""
    return F.concat(condition, F.lit("__"), sample_id)


def parse_key(key: Column) -> Column:
    """``baseline__id`` or ``pNN__severity__id`` as a struct; the id may hold the separator."""
    parts = F.split(key, "__", 3)
    rest = F.split(key, "__", 2)
    base = F.get(parts, F.lit(0)) == "baseline"
    number = F.when(~base, F.substring(F.get(parts, F.lit(0)), 2, 10).try_cast("int"))
    return F.struct(number.alias("perturbation_id"), F.when(~base, F.get(parts, F.lit(1))).alias("severity"), F.when(base, F.get(rest, F.lit(1))).otherwise(F.get(parts, F.lit(2))).alias("sample_id"))


def p_value_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "n.s.")


def https_of_gs(uri: Column) -> Column:
    return F.regexp_replace(uri, "^gs://", "https://storage.googleapis.com/")


def series_age(text: Column) -> Column:
    """``063Y`` as a number of years; null if it is none."""
    return F.rtrim(F.trim(text), F.lit("Y")).try_cast("double")


def safe_part(text: Column) -> Column:
    return F.regexp_replace(text, r'[<>:"/\\|?*]', "_")


def attachment_name(header: Column, fallback: Column) -> Column:
    found = F.trim(F.regexp_extract(header, r"filename=\"?([^\";]*)", 1))
    return F.coalesce(F.nullif(found, F.lit("")), fallback)


def folder_id(url: Column) -> Column:
    """A bare id of ten characters or more, the part after ``/folders/`` or the ``id`` parameter; else null."""
    bare = F.when(url.rlike(r"^[A-Za-z0-9_-]{10,}$"), url)
    part = F.nullif(F.regexp_extract(url, r"/folders/([A-Za-z0-9_-]+)", 1), F.lit(""))
    return F.coalesce(bare, part, F.nullif(F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]+)", 1), F.lit("")))


def parse_term(term: Column) -> Column:
    """``C(perturbation_id)[T.9]`` as 9."""
    return F.nullif(F.regexp_extract(term, r"\[T\.(\d+)\]", 1), F.lit("")).cast("int")
