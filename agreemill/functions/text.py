"""Text column functions: subject stripping, clean-up and name parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agreemill.functions.numbers import c

STRIPPERS = ("regex", "syntax", "none")

#: Short method names and their sample folders.
METHOD_DIRS = {
    "textual_inversion_sd": "textual_inversion_sd_gs7_5_step100_seed42_torch_float16",
    "dreambooth_sd": "dreambooth_sd_gs7_5_step100_seed42_torch_float16",
    "dreambooth_lora_sdxl": "dreambooth_lora_sdxl_gs7_5_step100_seed42_torch_float16",
    "blip_diffusion": "blip_diffusion_gs7_5_step100_seed42_torch_float16",
    "emu2": "emu2_gs3_step50_seed42_torch_bfloat16",
    "ip_adapter_plus_vit_h_sdxl": "ip_adapter_plus_vit_huge_sdxl_scale0_6_gs7_5_step100_seed42_torch_float16",
    "ip_adapter_vit_g_sdxl": "ip_adapter_vit_giant_sdxl_scale0_6_gs7_5_step100_seed42_torch_float16",
}
#: Prefixes of subject folders, tried in this order.
CATEGORIES = ("live_subject_animal", "live_subject_human", "object", "style")


def bare(text: Column | str) -> Column:
    """No white space of any kind at the ends."""
    return F.regexp_replace(c(text), r"(?U)^\s+|\s+$", "")


def collapse(text: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c(text), r"(?U)\s+", " "))


def quoted(text: Column) -> Column:
    """A regular expression that matches the text itself."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def strip_subject(prompt: Column | str, subject: Column | str, stripper: str = "regex") -> Column:
    """The prompt without its subject.

    ``regex``: with an article if that occurs anywhere, else bare; all
    occurrences, whatever their case; then white space is collapsed.
    ``none``: the prompt as it is. ``syntax`` needs parsed tokens; see
    ``operators.syntax``.
    """
    if stripper == "none":
        return c(prompt)
    if stripper != "regex":
        raise ValueError(f"no column function for stripper {stripper!r}; known: {', '.join(STRIPPERS)}")
    prompt, subject = c(prompt), F.coalesce(bare(subject), F.lit(""))
    alone = F.concat(F.lit(r"(?iu)\b"), quoted(subject), F.lit(r"\b"))
    full = F.concat(F.lit(r"(?iu)\b(?:a|an|the)\s+"), quoted(subject), F.lit(r"\b"))
    cut = F.when(F.regexp_like(prompt, full), F.regexp_replace(prompt, full, F.lit(""))).otherwise(F.regexp_replace(prompt, alone, F.lit("")))
    return collapse(F.when(subject == "", prompt).otherwise(cut))


def was_stripped(prompt: Column | str, stripped: Column | str) -> Column:
    """Do the words differ, white space aside?"""
    return collapse(prompt) != collapse(stripped)


def tidy_punctuation(text: Column | str) -> Column:
    """No space before punctuation, none of comma, colon or semicolon in front."""
    spaced = F.regexp_replace(collapse(text), r"\s+([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(spaced, r"^[\s,;:]+", ""))


def subject_parts(folder: Column | str) -> Column:
    """struct(category, idx, keyword) of a subject folder; unknown names raise."""
    pattern = f"^({'|'.join(CATEGORIES)})_([^_]+)_(.+)$"
    part = [F.regexp_extract(c(folder), pattern, i) for i in (1, 2, 3)]
    category = F.when(part[0] != "", part[0]).otherwise(F.raise_error(F.concat(F.lit("unknown subject folder: "), c(folder))))
    slashed = F.replace(F.replace(category, F.lit("live_subject_animal"), F.lit("live_subject/animal")), F.lit("live_subject_human"), F.lit("live_subject/human"))
    return F.struct(slashed.alias("category"), part[1].alias("idx"), part[2].alias("keyword"))


def stem_parts(stem: Column | str) -> Column:
    """struct(prompt_id, seed) of a file stem; NULL without an underscore."""
    parts = F.split(c(stem), "_", 2)
    seed = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0))
    return F.when(F.size(parts) == 2, F.struct(F.get(parts, F.lit(0)).alias("prompt_id"), seed.alias("seed")))


def method_dir(method: Column | str) -> Column:
    """The folder of a method; unknown names pass through."""
    known = F.create_map(*[F.lit(x) for pair in METHOD_DIRS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, c(method)), c(method))


def key_of(concept_id: Column | str, prompt_id: Column | str) -> Column:
    return F.concat(c(concept_id), F.lit("-"), c(prompt_id))


def model_tag(model: Column | str) -> Column:
    """The first two dash-separated parts of a model's last path part."""
    last = F.element_at(F.split(c(model), "/"), -1)
    return F.array_join(F.slice(F.split(last, "-"), 1, 2), "-")


def is_style(category: Column | str) -> Column:
    return F.startswith(c(category), F.lit("style"))


def comma_list(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(c(text), ","), lambda x: bare(x)), lambda x: x != "")


def segmenter_prompt(name: Column | str) -> Column:
    """Lower case with a final period."""
    low = F.lower(bare(name))
    return F.when(F.endswith(low, F.lit(".")), low).otherwise(F.concat(low, F.lit(".")))


def is_naflex(model: Column | str) -> Column:
    return F.contains(F.lower(c(model)), F.lit("naflex"))


def is_clip(model: Column | str) -> Column:
    """A model of the CLIP family, by its published name."""
    return F.startswith(c(model), F.lit("openai/clip-"))


def perturbation_label(p: Column | str) -> Column:
    """Erode or Dilate with the percentage, or Default."""
    pct = F.concat(F.bround(F.abs(c(p)) * 100, 0).cast("int").cast("string"), F.lit("%"))
    return F.when(c(p) < 0, F.concat(F.lit("Erode "), pct)).when(c(p) > 0, F.concat(F.lit("Dilate "), pct)).otherwise(F.lit("Default"))


def result_name(signal: Column | str, model: Column | str, tag: Column | str, method: Column | str) -> Column:
    """The name of a run's results: signal, short model, tag (if any), method."""
    return F.concat_ws("__", c(signal), model_tag(model), F.when(c(tag) != "", c(tag)), c(method))
