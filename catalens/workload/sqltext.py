"""SQL text of the scalar rules, for the DuckDB side of the comparison.

Edges, labels, words and patterns here are fixed values: they restate what the
rules must give, on their own and not from the library's constants.
"""

from __future__ import annotations

from collections.abc import Sequence

SPACE = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"


def clean(x: str) -> str:
    no_tags = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', '', 'g')"
    spaced = f"regexp_replace({no_tags}, '{SPACE}', ' ', 'g')"
    return rf"trim(regexp_replace({spaced}, '[^\p{{L}}\p{{N}}_\s\p{{Z}}.,!?-]', '', 'g'))"


def price(x: str) -> str:
    return rf"TRY_CAST(replace(regexp_replace({x}, '[^\d.,]', '', 'g'), ',', '') AS DOUBLE)"


def category(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = 'Missing' THEN 'Unknown' ELSE {x} END"


def cut(x: str, edges: Sequence, labels: Sequence[str], closed_low: bool = True) -> str:
    arms = [f"WHEN {x} IS NULL OR {x} {'<' if closed_low else '<='} {edges[0]} THEN NULL"]
    for edge, label in zip(edges[1:], labels):
        arms.append(f"WHEN {'true' if edge is None else f'{x} <= {edge}'} THEN '{label}'")
    return f"CASE {' '.join(arms)} END"


def steps(x: str, rules: Sequence, missing: str = "Unknown") -> str:
    arms = [f"WHEN {x} IS NULL THEN '{missing}'"]
    arms += [f"WHEN {'true' if limit is None else f'{x} < {limit}'} THEN '{label}'" for limit, label in rules]
    return f"CASE {' '.join(arms)} END"


def price_bin_usd(x: str) -> str:
    return cut(x, [0, 500, 1000, 2000, None], ["Budget", "Mid-range", "High-end", "Premium"])


def price_bin_local(x: str) -> str:
    return cut(x, [0, 2375, 4750, 9500, None], ["Budget", "Mid-range", "High-end", "Premium"])


def rating_bin(x: str) -> str:
    return cut(f"{x}", [0, 2, 3, 4, 5], ["Poor", "Fair", "Good", "Excellent"])


def length_bin(x: str) -> str:
    return cut(x, [0, 100, 500, 1000, None], ["Short", "Medium", "Long", "Very Long"], closed_low=False)


def storage_category(x: str) -> str:
    return steps(x, [(256, "Small (<256GB)"), (512, "Medium (256-512GB)"), (1000, "Large (512GB-1TB)"), (None, "Very Large (>1TB)")])


def ram_category(x: str) -> str:
    return steps(x, [(8, "Low (<8GB)"), (16, "Medium (8-16GB)"), (32, "High (16-32GB)"), (None, "Very High (>32GB)")])


def screen_category(x: str) -> str:
    return steps(x, [(13, 'Small (<13")'), (15, 'Medium (13-15")'), (17, 'Large (15-17")'), (None, 'Very Large (>17")')])


def storage_display(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 1024 THEN format('{{:.1f}}TB', round_even({x} / 1024, 1)) "
        f"WHEN {x} IS NOT NULL THEN format('{{:.0f}}GB', round_even({x}, 0)) END"
    )


def first_match(x: str, patterns: Sequence[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p}', 1), '')" for p in patterns) + ")"


def title_case(x: str) -> str:
    return (
        f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i > 1 AND "
        rf"regexp_matches(substr({x}, i - 1, 1), '\p{{L}}') THEN lower(substr({x}, i, 1)) ELSE upper(substr({x}, i, 1)) END), '')"
    )


def cpu_name(x: str) -> str:
    name = f"trim(regexp_replace(lower({x}), '{SPACE}', ' ', 'g'))"
    for word in ("processor", "cpu", "apu", "dual", "quad"):
        name = f"replace({name}, '{word}', '')"
    name = rf"regexp_replace({name}, '@\s*\d+\.?\d*ghz', '', 'g')"
    return f"CASE WHEN {x} IS NULL OR {x} = 'Unknown' THEN 'Unknown' ELSE trim(regexp_replace({name}, '{SPACE}', ' ', 'g')) END"


def gpu_name(x: str) -> str:
    name = f"trim(regexp_replace(lower({x}), '{SPACE}', ' ', 'g'))"
    for word in ("graphics", "card", "gpu"):
        name = f"replace({name}, '{word}', '')"
    return f"CASE WHEN {x} IS NULL OR {x} IN ('Unknown', '0') THEN 'Unknown' ELSE trim(regexp_replace({name}, '{SPACE}', ' ', 'g')) END"


def occurrences(text: str, pattern: str) -> str:
    """Overlapping occurrences."""
    return (
        f"CASE WHEN contains({text}, {pattern}) THEN len(list_filter(range(1, length({text}) + 1), "
        f"lambda i: substr({text}, i, length({pattern})) = {pattern})) ELSE 0 END"
    )


def ram(t: str) -> str:
    number = r"(\d+(?:\.\d+)?)"
    value = first_match(
        t,
        [
            number + r"\s*gb\s*(?:ddr\d*|ram|memory)",
            number + r"\s*gb",
            number + r"\s*tb\s*(?:ddr\d*|ram|memory)",
            number + r"\s*tb",
        ],
    )
    return f"CAST({value} AS DOUBLE) * CASE WHEN contains({t}, 'tb') AND NOT contains({t}, 'gb') THEN 1024 ELSE 1 END"


def storage(t: str) -> str:
    number = r"(\d+(?:\.\d+)?)"
    words = r"\s*(?:ssd|hdd|hard\s*drive|storage|flash\s*storage|nvme|pcie)"
    free = " AND ".join(f"NOT contains({t}, '{w}')" for w in ("ram", "memory", "ddr", "lpddr"))

    def amount(pattern: str) -> str:
        return f"CAST({first_match(t, [pattern])} AS DOUBLE)"

    return (
        f"coalesce({amount(number + r'\s*tb' + words)} * 1024, {amount(number + r'\s*gb' + words)}, "
        f"CASE WHEN {free} THEN coalesce({amount(number + r'\s*tb')} * 1024, {amount(number + r'\s*gb')}) END)"
    )


def screen(t: str) -> str:
    number = r"(\d+(?:\.\d+)?)"
    return f"CAST({first_match(t, [number + r'\s*inch', number + r'\s*"', number + r'\s*in'])} AS DOUBLE)"


def storage_type(t: str) -> str:
    return (
        f"CASE WHEN contains({t}, 'ssd') THEN CASE WHEN contains({t}, 'nvme') THEN 'NVMe SSD' "
        f"WHEN contains({t}, 'pcie') THEN 'PCIe SSD' ELSE 'SSD' END "
        f"WHEN contains({t}, 'hdd') OR contains({t}, 'hard drive') OR contains({t}, 'hard disk') THEN 'HDD' "
        f"WHEN contains({t}, 'hybrid') THEN 'Hybrid' WHEN contains({t}, 'emmc') THEN 'eMMC' "
        f"WHEN contains({t}, 'flash') THEN 'Flash Storage' END"
    )


def ram_type(t: str) -> str:
    return f"CASE WHEN contains({t}, 'ddr5') THEN 'DDR5' WHEN contains({t}, 'ddr4') THEN 'DDR4' WHEN contains({t}, 'ddr3') THEN 'DDR3' END"


def cpu_model(t: str) -> str:
    patterns = [
        r"(intel\s+core\s+i[3579]-\d+[a-z]*\d*)",
        r"(amd\s+ryzen\s+[3579]\s+\d+[a-z]*\d*)",
        r"(intel\s+celeron\s+[a-z]*\d*)",
        r"(intel\s+pentium\s+[a-z]*\d*)",
        r"(amd\s+athlon\s+\d+[a-z]*)",
        r"(apple\s+m\d+\s*[a-z]*)",
    ]
    return title_case(first_match(t, patterns))


def gpu_model(t: str) -> str:
    patterns = [
        r"(intel\s+uhd\s+graphics\s*\d*)",
        r"(intel\s+iris\s+xe\s+graphics\s*[a-z0-9]*)",
        r"(amd\s+radeon\s+vega\s*\d+)",
        r"(amd\s+radeon\s+graphics)",
        r"(nvidia\s+geforce\s+gtx\s*\d{4}[a-z]*)",
        r"(nvidia\s+geforce\s+rtx\s*\d{4}[a-z]*)",
        r"(nvidia\s+quadro\s*[a-z0-9]+)",
        r"(amd\s+radeon\s+rx\s*\d{4}[a-z]*)",
        r"(amd\s+radeon\s+pro\s*\d{4}[a-z]*)",
    ]
    return title_case(first_match(t, patterns))


def spec_columns(t: str) -> str:
    """The seven specs of a text column."""
    return (
        f"{ram(t)} AS ram_gb, {storage(t)} AS storage_gb, {screen(t)} AS screen_size_inches, {storage_type(t)} AS storage_type, "
        f"{ram_type(t)} AS ram_type, {cpu_model(t)} AS processor_model, {gpu_model(t)} AS gpu_model"
    )


def spec_categories() -> str:
    return (
        f"{storage_category('storage_gb')} AS storage_category, {storage_display('storage_gb')} AS storage_display, "
        f"{ram_category('ram_gb')} AS ram_category, {screen_category('screen_size_inches')} AS screen_category"
    )


def spec_stage(source: str, texts: Sequence[str]) -> str:
    """Source rows with all spec columns."""
    combined = f"lower(concat_ws(' ', {', '.join(texts)}))"
    return (
        f"SELECT *, {spec_categories()} FROM (SELECT * EXCLUDE (t), {spec_columns('t')} "
        f"FROM (SELECT *, {combined} AS t FROM ({source}) AS a) AS b) AS c"
    )


def map_value(details: str, key_test: str, value: str) -> str:
    """First value of a JSON object whose key passes and whose value reads; `k`, `v` name key and value."""
    keys = f"CASE WHEN json_valid({details}) THEN json_keys({details}) ELSE [] END"
    return (
        f"list_filter(list_transform(list_filter({keys}, lambda k: {key_test}), "
        f"lambda k: {value.replace('$v', f'''json_extract_string({details}, '$.\"' || k || '\"')''')}), lambda x: x IS NOT NULL)[1]"
    )
