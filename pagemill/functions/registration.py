"""Registration numbers that Chinese sites show, and the provinces they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, literal_map

NAMES = (
    "安徽皖 北京京 福建闽 甘肃甘陇 广东粤 广西桂 贵州贵黔 海南琼 河北冀 河南豫 黑龙江黑 湖北鄂 湖南湘 吉林吉 江苏苏 江西赣 辽宁辽 内蒙古蒙 "
    "宁夏宁 青海青 山东鲁 山西晋 陕西陕秦 上海沪 四川川蜀 天津津 西藏藏 新疆新 云南云滇 浙江浙 重庆渝 中国香港港 中国澳门澳 中国台湾台"
).split()
TWO = {"甘肃甘陇", "贵州贵黔", "陕西陕秦", "四川川蜀", "云南云滇"}
PROVINCES = {short: (n[:-2] if n in TWO else n[:-1]) for n in NAMES for short in (n[-2:] if n in TWO else n[-1:])}
SHORT = "".join(s for s in PROVINCES if s not in "港澳台")
ICP = f"(?i)([{SHORT}])ICP(?:备案|备|证)?[0-9]+"
POLICE = f"([{SHORT}])公网安备[0-9]+"
TELECOM = f"(?i)([{SHORT}])B2-[0-9]+"

#: The same three, found by what follows the province and looking back at it: a class of so many signs is slow to try at every character.
BY_MARK = (f"(?i)ICP(?<=([{SHORT}])ICP)(?:备案|备|证)?[0-9]+", f"公网安备(?<=([{SHORT}])公网安备)[0-9]+", f"(?i)B2-(?<=([{SHORT}])B2-)[0-9]+")


def icp_from_text(text: Column) -> Column:
    """struct(icp, province_short): the first registration, else police, else telecom number. The text is made and searched once."""

    def read(t: Column) -> Column:
        found = F.filter(F.array(*[F.concat(F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 0)) for p in BY_MARK]), lambda x: x != "")
        return let(F.coalesce(F.get(found, 0), F.lit("")), lambda x: F.struct(x.alias("icp"), F.substring(x, 1, 1).alias("province_short")))

    return let(blank(text), read)


def icp_doc(body: Column) -> Column:
    return icp_from_text(F.regexp_replace(blank(body), "[\\n\\r\\t ]+", ""))


def province_name(short: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(PROVINCES), blank(short)), F.lit(""))
