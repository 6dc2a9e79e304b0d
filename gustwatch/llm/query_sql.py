"""Parts that the SQL of several queries shares."""


def crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text, bit by bit; null stays null."""
    bits = "list_concat([xor(c, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0])"
    step = "(x, y) -> CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    codes = f"list_transform(range(length({text})), lambda k: CAST(ascii(substr({text}, CAST(k + 1 AS BIGINT), 1)) AS BIGINT))"
    return (
        f"xor(list_reduce(list_concat([4294967295], {codes}), "
        f"lambda c, b: list_reduce({bits}, lambda {step.replace('(x, y) ->', 'x, y:')})), 4294967295)"
    )


def words(text: str) -> str:
    """The words between blanks and the controls from tab to carriage return; null has none."""
    return rf"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
