"""x86-64 operands and instructions as column expressions: what an instruction defines and uses.

Operands follow one small grammar (`OPERAND`), instructions a table of kinds (`KINDS`); both are evaluated inside the JVM. Registers other than
those of x86-64 aren't normalised. Null code counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GLOBAL, CONST, FLAGS = "GLOBAL", "CONST", "EFLAGS"
#: The order in which a register is looked for in an address; frame and stack pointers are never taken.
ADDRESS_ORDER = ("rax", "rbx", "rcx", "rdx", "rsi", "rdi", *(f"r{n}" for n in range(8, 16)))
#: Arguments of a call.
ARGUMENTS = ("rdi", "rsi", "rdx", "rcx", "r8", "r9")
#: Mnemonics that define the flags, and those that use them: fixed values.
SETS_FLAGS = "test add sub and or xor imul idiv cmp shl shr sar shld shrd rol ror rcl rcr sal sbb adc neg not inc dec mul div".split()
USES_FLAGS = """
    jnz jz jnb jb jnl jl jno jo jnp jp jns js jnc jc jnge jge jng jg jne je jna ja jnae jae jnbe jbe
    setnz setz setnb setb setnl setl setno seto setnp setp setns sets setnc setc setnge setge setng setg setne sete setna seta setnae setae setnbe setbe
    cmovnz cmovz cmovnb cmovb cmovnl cmovl cmovno cmovo cmovnp cmovp cmovns cmovs cmovnc cmovc cmovnge cmovge cmovng cmovg cmovne cmove cmovna cmova cmovnae cmovae cmovnbe cmovbe
    jle jcxz jecxz loop loope loopne adc
    """.split()

#: Parts of registers and the whole ones, by naming rule: the parts' pattern, and the name of the whole.
PARTS = ((r"^(?:[er]?([abcd])x|([abcd])[lh])\z", "r$1$2x"), (r"^(?:[er]?(si|di|bp|sp)|(si|di|bp|sp)l)\z", "r$1$2"), (r"^(r(?:[89]|1[0-5]))[bwd]?\z", "$1"))
REGISTER = "|".join(pattern for pattern, _ in PARTS)
#: Size words and segments, which say nothing about what is accessed; labels with their numbers; marks of code: fixed values.
_SIZES = r"(?:xmmword |dword |qword |word |byte |short )?ptr "
_SEGMENTS = r"^(?:[csfdeg]s:)+"
_LABELLED = r"(?s)^(?:(?:loc|off|unk|sub|arg|def|var)_([0-9A-F]*))?\s*(?:locret)?(.*)\z"
_CODE = "offset|off_|loc_|unk_"
_HEX, _NUMBER = r"[+-]?[0-9A-F]*h", r"[+-]?[0-9]+|[+-]"
#: An operand without its label: something in parentheses, a constant, an address, or a name.
OPERAND = rf"(?s)^(?:(?<inner>\(.*\))|(?<constant>{_HEX}|{_NUMBER})|(?<address>\[.*\])|(?<name>.*))\z"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with its argument computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bare(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def _whole(x: Column) -> Column:
    """A register's part as the whole register; other names as they are."""
    for pattern, whole in PARTS:
        x = F.regexp_replace(x, pattern, whole)
    return x


def is_register(x: Column) -> Column:
    return x.rlike(REGISTER)


def is_hex(x: Column) -> Column:
    return x.rlike(rf"^{_HEX}\z")


def is_number(x: Column) -> Column:
    return x.rlike(rf"^(?:{_NUMBER})\z")


def is_address(x: Column) -> Column:
    return x.startswith("[") & x.endswith("]")


def is_global_memory(x: Column) -> Column:
    """An address that isn't on the stack."""
    return is_address(x) & ~x.rlike("stack|rbp|rsp")


def is_important(x: Column) -> Column:
    """A variable whose definition matters outside a function: memory off the stack and named data."""
    return _let(_bare(x), lambda v: (v == GLOBAL) | ~(v.isin(CONST, FLAGS) | is_register(v) | is_number(v) | is_hex(v)) & F.when(is_address(v), is_global_memory(v)).otherwise(~v.contains("stack")))


def _address_term(term: Column) -> Column:
    """A summand of an address: a frame offset's name, an index times its scale, or a whole register."""
    return _let(_bare(term), lambda x: F.when(x.rlike("^(?:var_|arg_)"), _bare(F.substr(x, F.lit(5)))).when(x.contains("*"), F.regexp_replace(x, r"\s*\*\s*", "*")).otherwise(_whole(x)))


def _address(x: Column) -> Column:
    inside = F.substr(x, F.lit(2), F.length(x) - 2)
    return F.concat(F.lit("["), F.array_join(F.transform(F.split(inside, r"\+"), _address_term), "+"), F.lit("]"))


def operand_form(operator: Column, place: Column, operand: Column) -> Column:
    """An operand in normal form: constants and code labels as CONST, whole registers, addresses as [a+b]; imports, call targets and addresses of data keep their names. Places count from 1."""
    sized = F.replace(F.regexp_replace(F.btrim(operand), _SIZES, ""), F.lit("-"), F.lit("+"))
    clean = _bare(F.regexp_replace(_bare(sized), _SEGMENTS, ""))

    def form(number: Column, rest: Column) -> Column:
        group = lambda k: F.regexp_extract(rest, OPERAND, k)  # noqa: E731  '' where the operand is something else
        named = (operator == "extrn") | (operator == "call") & (place == 1) & (F.length(rest) > 3) | (operator == "lea") & (place == 2) & ~(is_hex(rest) | is_address(rest))
        return (
            F.when(group(1) != "", _bare(F.substr(rest, F.lit(2), F.length(rest) - 2)))
            .when(named & (rest != ""), rest)
            .when(group(2) != "", F.lit(CONST))
            .when(group(3) != "", F.concat(number, _address(rest)))
            .otherwise(F.concat(number, _whole(rest)))
        )

    def labelled(x: Column) -> Column:
        to_code = operand.rlike(_CODE) | operator.contains("lea") & operand.contains("sub_") | operator.startswith("j") & ~is_register(x)
        parts = F.struct(F.regexp_extract(x, _LABELLED, 1).alias("number"), F.regexp_extract(x, _LABELLED, 2).alias("rest"))
        return F.when(to_code, F.lit(CONST)).otherwise(_let(parts, lambda p: form(p["number"], p["rest"])))

    return _let(clean, labelled)


def address_register(x: Column) -> Column:
    """The register that an address uses; null if it uses none."""
    return F.coalesce(*(F.when(x.contains(r), F.lit(r)) for r in ADDRESS_ORDER))


def operand_kind(form: Column) -> Column:
    """What a normal form is: register, number, hex, global, address (on the stack), name or empty."""
    kinds = {"register": is_register, "number": is_number, "hex": is_hex, "global": is_global_memory, "address": is_address, "name": lambda x: x != ""}
    return F.coalesce(*(F.when(test(form), F.lit(kind)) for kind, test in kinds.items()), F.lit("empty"))


#: Classes of instructions, and what their operands are to them: pattern of the mnemonic, number of operands (2 for two or more; None for any), whether the first two
#: must be equal, what is defined, what is used. Letters name variables: a, b the first and second operand; A, B the same with GLOBAL beside memory off the stack;
#: s the stack slot of the first operand; r the register of results. The first that fits counts. `test` is one that defines its first operand, unless flags are strict.
KINDS = (
    (r"^push\z", None, False, "s", "a"),
    (r"^pop\z", None, False, "a", "s"),
    ("call", 1, False, "r", "A"),
    ("j|ret", 1, False, "", "A"),
    ("", 1, False, "a", "A"),
    ("mov", 2, False, "A", "B"),
    ("cmp", 2, False, "", "AB"),
    ("xchg", 2, True, "", ""),
    ("xor", 2, True, "a", ""),
    ("", 2, False, "A", "AB"),
)
STRICT_TEST = ("test", 2, False, "", "AB")


def _names(*xs: str | Column) -> Column:
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<string>")


def _only_if(condition: Column, name: str) -> Column:
    return F.when(condition, _names(name)).otherwise(_names())


def _variables(letters: Column, ops: Column) -> Column:
    """What the letters of a kind name."""

    def named(letter: Column) -> Column:
        operand = F.coalesce(F.get(ops, letter.isin("b", "B").cast("int")), F.lit(""))
        wide = lambda x: letter.isin("A", "B") & is_global_memory(x)
        return F.when(letter == "r", _names("rax")).otherwise(_let(operand, lambda x: F.when(letter == "s", _names(F.concat(F.lit("stack_"), x))).when(wide(x), _names(x, GLOBAL)).otherwise(_names(x))))

    return F.flatten(F.transform(letters, named))


def effects(code: Column, strict_flags: bool = False) -> Column:
    """(operator, defs, uses) of an instruction, by its kind; beside that, addresses use their register, returns the result, and flags are set and used by mnemonic.

    A comment after ';' is cut. Of up to three operands the third is only looked at for its address register. Without operands there are none of a kind's effects, `push` and `pop` apart.
    """

    def of(i: Column) -> Column:
        operator, ops = i["operator"], i["ops"]
        count, same = F.least(F.size(ops), F.lit(2)), (F.size(ops) > 1) & (F.get(ops, F.lit(0)) == F.get(ops, F.lit(1)))

        def fits(mnemonic: str, operands: int | None, equal: bool) -> Column:
            found = operator.rlike(mnemonic) if mnemonic else F.lit(True)
            found = found if operands is None else found & (count == operands)
            return found & same if equal else found

        kinds = [F.when(fits(*rule), F.struct(_names(*defs).alias("defs"), _names(*uses).alias("uses"))) for *rule, defs, uses in ((STRICT_TEST, *KINDS) if strict_flags else KINDS)]
        kind = F.coalesce(*kinds, F.struct(_names().alias("defs"), _names().alias("uses")))
        registers = F.array_compact(F.transform(ops, lambda x: F.when(is_address(x), address_register(x))))
        uses = F.concat(registers, _only_if(operator.contains("ret"), "rax"), _only_if(operator.isin(USES_FLAGS), FLAGS), _variables(kind["uses"], ops))
        defs = F.concat(_only_if(operator.isin(SETS_FLAGS), FLAGS), _variables(kind["defs"], ops))
        return F.struct(operator.alias("operator"), F.array_distinct(defs).alias("defs"), F.array_distinct(uses).alias("uses"))

    def split(i: Column) -> Column:
        operands = F.when(i["rest"] == "", _names()).otherwise(F.slice(F.split(i["rest"], ","), 1, 3))
        return F.struct(i["operator"].alias("operator"), F.transform(operands, lambda x, k: operand_form(i["operator"], k + 1, x)).alias("ops"))

    def cut(line: Column) -> Column:
        operator = F.substring_index(line, " ", 1)
        return F.struct(operator.alias("operator"), F.substr(line, F.length(operator) + 2).alias("rest"))

    line = F.substring_index(F.coalesce(code, F.lit("")), ";", 1)
    return _let(_let(_let(line, cut), split), of)
