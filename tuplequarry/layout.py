"""What the on-disk format fixes: types, encodings, catalog layouts; and the descriptions of tables built on them.

Nothing here is state: a scan gets its description as a value, is pickled with it, and needs no process globals.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

PAGE_SIZES = (8192, 16384, 32768)
KINDS = {"r": "table", "i": "index", "S": "sequence", "t": "toast table", "v": "view", "m": "materialized view", "c": "type", "f": "foreign table", "p": "partitioned table", "I": "partitioned index"}

# Oid, catalog name, SQL name, length (-1 variable, -2 string), alignment, oid of the array type (0 none).
_TYPES = """
16 bool boolean 1 c 1000
17 bytea bytea -1 i 1001
18 char "char" 1 c 1002
19 name name 64 c 1003
20 int8 bigint 8 d 1016
21 int2 smallint 2 s 1005
22 int2vector int2vector -1 i 1006
23 int4 integer 4 i 1007
24 regproc regproc 4 i 1008
25 text text -1 i 1009
26 oid oid 4 i 1028
27 tid tid 6 s 1010
28 xid xid 4 i 1011
29 cid cid 4 i 1012
30 oidvector oidvector -1 i 1013
32 pg_ddl_command pg_ddl_command 8 d 0
114 json json -1 i 199
142 xml xml -1 i 143
194 pg_node_tree pg_node_tree -1 i 0
600 point point 16 d 1017
601 lseg lseg 32 d 1018
602 path path -1 d 1019
603 box box 32 d 1020
604 polygon polygon -1 d 1027
628 line line 24 d 629
650 cidr cidr -1 i 651
700 float4 real 4 i 1021
701 float8 double_precision 8 d 1022
705 unknown unknown -2 c 0
718 circle circle 24 d 719
774 macaddr8 macaddr8 8 i 775
790 money money 8 d 791
829 macaddr macaddr 6 i 1040
869 inet inet -1 i 1041
1033 aclitem aclitem 12 i 1034
1042 bpchar character -1 i 1014
1043 varchar character_varying -1 i 1015
1082 date date 4 i 1182
1083 time time 8 d 1183
1114 timestamp timestamp 8 d 1115
1184 timestamptz timestamp_with_time_zone 8 d 1185
1186 interval interval 16 d 1187
1266 timetz time_with_time_zone 12 d 1270
1560 bit bit -1 i 1561
1562 varbit bit_varying -1 i 1563
1700 numeric numeric -1 i 1231
2950 uuid uuid 16 c 2951
3361 pg_ndistinct pg_ndistinct -1 i 0
3402 pg_dependencies pg_dependencies -1 i 0
3802 jsonb jsonb -1 i 3807
4659 int16 numeric 16 d 0
5017 pg_mcv_list pg_mcv_list -1 i 0
8020 oradate timestamp 8 d 0
"""


@dataclass(frozen=True)
class Type:
    oid: int
    name: str
    sql: str
    length: int
    align: str
    elem: int = 0


def _types() -> dict[int, Type]:
    out = {}
    for line in _TYPES.strip().splitlines():
        oid, name, sql, length, align, array = line.split()
        t = Type(int(oid), name, sql.replace("_", " ") if sql != name else sql, int(length), align)
        out[t.oid] = t
        if int(array):
            out[int(array)] = Type(int(array), f"_{name}", f"{t.sql}[]", -1, "d" if align == "d" else "i", t.oid)
    return out


TYPES = _types()
OID = {t.name: t.oid for t in TYPES.values()}

# Server encoding ids and the codecs that read them.
ENCODINGS = {
    0: "latin-1", 1: "euc_jp", 2: "gb2312", 3: "euc_kr", 5: "euc_jp", 6: "utf-8", 7: "latin-1", 8: "latin-1", 9: "iso8859-2", 10: "iso8859-3",
    11: "iso8859-4", 12: "iso8859-9", 13: "iso8859-10", 14: "iso8859-13", 15: "iso8859-14", 16: "iso8859-15", 17: "iso8859-16", 18: "cp1256",
    19: "cp1258", 20: "cp866", 21: "cp874", 22: "koi8-r", 23: "cp1251", 24: "cp1252", 25: "iso8859-5", 26: "iso8859-6", 27: "iso8859-7",
    28: "iso8859-8", 29: "cp1250", 30: "cp1253", 31: "cp1254", 32: "cp1255", 33: "cp1257", 34: "koi8-u", 36: "shift_jis", 37: "big5", 38: "gbk",
    39: "cp949", 40: "gb18030", 41: "johab", 42: "shift_jis",
}


@dataclass(frozen=True)
class Column:
    name: str
    type_oid: int
    length: int = 0  # 0: as the type has it
    attnum: int = 0
    typmod: int = -1
    notnull: bool = False
    dropped: bool = False
    align: str = ""
    byval: bool = False
    storage: str = "p"

    @property
    def size(self) -> int:
        return self.length or (TYPES[self.type_oid].length if self.type_oid in TYPES else -1)

    @property
    def alignment(self) -> int:
        a = self.align or (TYPES[self.type_oid].align if self.type_oid in TYPES else "")
        if not a:
            n = self.size
            a = "i" if n < 0 or 4 <= n < 8 else "d" if n >= 8 else "s" if n >= 2 else "c"
        return {"c": 1, "s": 2, "i": 4, "d": 8}[a]


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    schema: str = "public"
    database: str = ""
    relfilenode: int = 0
    oid: int = 0
    toastrelid: int = 0
    relkind: str = "r"
    primary_key: tuple[str, ...] = ()
    enums: dict = field(default_factory=dict)  # type oid -> {member oid: label}, in catalog order
    type_names: dict = field(default_factory=dict)  # names of types beyond the built-in ones
    base_types: dict = field(default_factory=dict)  # domain's oid -> base type's oid

    @property
    def full_name(self) -> str:
        return f"{self.schema}.{self.name}"

    @property
    def live(self) -> tuple[Column, ...]:
        return tuple(c for c in self.columns if not c.dropped)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Table:
        d = json.loads(text)
        ints = lambda x: {int(k): v for k, v in x.items()}
        return Table(**d | {"columns": tuple(Column(**c) for c in d["columns"]), "primary_key": tuple(d["primary_key"]), "enums": {k: ints(v) for k, v in ints(d["enums"]).items()}, "type_names": ints(d["type_names"]), "base_types": ints(d["base_types"])})

    def resolved(self, oid: int) -> int:
        """The type below domains."""
        seen = set()
        while oid in self.base_types and oid not in seen:
            seen.add(oid)
            oid = self.base_types[oid]
        return oid


@dataclass(frozen=True)
class Context:
    """All that decoding a relation's bytes needs."""

    table: Table
    page_size: int = 8192
    psv_offset: int = 18  # where the page header keeps size and version
    pg_version: int = 16
    fork: bool = False
    encoding: str = "utf-8"
    roles: dict = field(default_factory=dict)
    mode: str = "typed"  # typed or text

    def only(self, names: list[str] | None) -> Context:
        """Columns that are not asked for stay in the layout and are not decoded."""
        if names is None:
            return self
        missing = sorted(set(names) - {c.name for c in self.table.live})
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}; there are: {', '.join(sorted(c.name for c in self.table.live))}")
        return replace(self, table=replace(self.table, columns=tuple(c if c.name in names else replace(c, dropped=True) for c in self.table.columns)))


def major(version: int) -> int:
    """16 of 16, 160004; 9 of 90600."""
    return version // 10000 if version >= 10000 else version or 12


def _columns(text: str) -> tuple[Column, ...]:
    return tuple(Column(n, OID[t], attnum=i + 1) for i, (n, t) in enumerate(x.split(":") for x in text.split()))


def _catalog(name: str, oid: int, text: str) -> Table:
    return Table(name, _columns(text), "pg_catalog", relfilenode=oid, oid=oid)


# Oids of the system catalogs, which are also the usual names of their files.
CATALOGS = {"pg_type": 1247, "pg_attribute": 1249, "pg_proc": 1255, "pg_class": 1259, "pg_authid": 1260, "pg_database": 1262, "pg_namespace": 2615, "pg_index": 2610, "pg_enum": 3501}

# The catalogs' leading columns. {o}: the oid column, a system column without a place up to version 11.
_CLASS = "{o} relname:name relnamespace:oid reltype:oid reloftype:oid relowner:oid relam:oid relfilenode:oid reltablespace:oid relpages:int4 reltuples:float4 relallvisible:int4 {f} reltoastrelid:oid relhasindex:bool relisshared:bool relpersistence:char relkind:char"
_NULLABLE_TAIL = " attacl:_aclitem attoptions:_text attfdwoptions:_text"
_ATTRIBUTE = {
    18: "attrelid:oid attname:name atttypid:oid attlen:int2 attnum:int2 atttypmod:int4 attndims:int2 attbyval:bool attalign:char attstorage:char attcompression:char attnotnull:bool atthasdef:bool atthasmissing:bool attidentity:char attgenerated:char attisdropped:bool attislocal:bool attinhcount:int2 attcollation:oid attstattarget:int2",
    17: "attrelid:oid attname:name atttypid:oid attlen:int2 attnum:int2 attcacheoff:int4 atttypmod:int4 attndims:int2 attbyval:bool attalign:char attstorage:char attcompression:char attnotnull:bool atthasdef:bool atthasmissing:bool attidentity:char attgenerated:char attisdropped:bool attislocal:bool attinhcount:int2 attcollation:oid attstattarget:int2",
    16: "attrelid:oid attname:name atttypid:oid attlen:int2 attnum:int2 attcacheoff:int4 atttypmod:int4 attndims:int2 attbyval:bool attalign:char attstorage:char attcompression:char attnotnull:bool atthasdef:bool atthasmissing:bool attidentity:char attgenerated:char attisdropped:bool attislocal:bool attinhcount:int2 attstattarget:int2 attcollation:oid",
    14: "attrelid:oid attname:name atttypid:oid attstattarget:int4 attlen:int2 attnum:int2 attndims:int2 attcacheoff:int4 atttypmod:int4 attbyval:bool attalign:char attstorage:char attcompression:char attnotnull:bool atthasdef:bool atthasmissing:bool attidentity:char attgenerated:char attisdropped:bool attislocal:bool attinhcount:int4 attcollation:oid",
    12: "attrelid:oid attname:name atttypid:oid attstattarget:int4 attlen:int2 attnum:int2 attndims:int2 attcacheoff:int4 atttypmod:int4 attbyval:bool attstorage:char attalign:char attnotnull:bool atthasdef:bool atthasmissing:bool attidentity:char attgenerated:char attisdropped:bool attislocal:bool attinhcount:int4 attcollation:oid",
    0: "attrelid:oid attname:name atttypid:oid attstattarget:int4 attlen:int2 attnum:int2 attndims:int2 attcacheoff:int4 atttypmod:int4 attbyval:bool attstorage:char attalign:char attnotnull:bool atthasdef:bool atthasmissing:bool attidentity:char attisdropped:bool attislocal:bool attinhcount:int2 attcollation:oid",
}
_FORK_ATTRIBUTE = "attrelid:oid attname:name atttypid:oid attstattarget:int4 attlen:int2 attnum:int2 attndims:int4 attcacheoff:int4 atttypmod:int4 attbyval:bool attstorage:char attalign:char attnotnull:bool atthasdef:bool atthasmissing:bool attidentity:char attgenerated:char attisdropped:bool attislocal:bool attinhcount:int2 attcollation:oid"


def catalog_table(name: str, version: int = 16, fork: bool = False) -> Table:
    """The leading columns of a system catalog in that version; later ones are of no use here and stay unread."""
    v = major(version)
    o = "oid:oid " if v >= 12 else ""
    if name == "pg_class":
        text = _CLASS.format(o=o, f="relallfrozen:int4" if v >= 18 else "")
    elif name == "pg_attribute":
        text = (_FORK_ATTRIBUTE if fork else _ATTRIBUTE[max(k for k in _ATTRIBUTE if k <= v)]) + _NULLABLE_TAIL
        if fork or v >= 12:
            text += " attmissingval:_text"
    elif name == "pg_type":
        text = f"{o}typname:name typnamespace:oid typowner:oid typlen:int2 typbyval:bool typtype:char typcategory:char typispreferred:bool typisdefined:bool typdelim:char typrelid:oid"
        text += " typsubscript:regproc typelem:oid typarray:oid" if v >= 14 else " typelem:oid typarray:oid"
        text += " typinput:regproc typoutput:regproc typreceive:regproc typsend:regproc typmodin:regproc typmodout:regproc typanalyze:regproc typalign:char typstorage:char typnotnull:bool typbasetype:oid"
    elif name == "pg_index":
        text = "indexrelid:oid indrelid:oid indnatts:int2 " + ("indnkeyatts:int2 " if v >= 11 else "") + "indisunique:bool " + ("indnullsnotdistinct:bool " if v >= 15 else "") + "indisprimary:bool indisexclusion:bool indimmediate:bool indisclustered:bool indisvalid:bool indcheckxmin:bool indisready:bool indislive:bool indisreplident:bool indkey:int2vector"
    elif name == "pg_enum":
        text = f"{o}enumtypid:oid enumsortorder:float4 enumlabel:{'text' if fork else 'name'}"
    else:
        text = {"pg_namespace": f"{o}nspname:name nspowner:oid", "pg_authid": f"{o}rolname:name", "pg_database": f"{o}datname:name datdba:oid encoding:int4"}[name]
    return _catalog(name, CATALOGS[name], text)


TOAST = Table("toast", _columns("chunk_id:oid chunk_seq:int4 chunk_data:bytea"), "pg_toast", relkind="t")
