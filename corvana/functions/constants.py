"""Labels, word lists and patterns that results depend on."""

DEFAULT_CATEGORY = "Chưa phân loại"
UPLOAD = "upload://"
CATEGORY_ALIASES = {"Công nghệ": "Số hóa", "Thời tiết Hà Nội": "Thời tiết Việt Nam"}

#: Category by source or link, first match wins: (column, substrings, category).
LINK_CATEGORIES = (
    ("source", ("Weather", "Thời Tiết"), "Thời tiết Việt Nam"),
    ("link", ("/thoi-su/",), "Thời sự"),
    ("link", ("/the-gioi/",), "Thế giới"),
    ("link", ("/kinh-doanh/",), "Kinh doanh"),
    ("link", ("/giai-tri/",), "Giải trí"),
    ("link", ("/the-thao/",), "Thể thao"),
    ("link", ("/phap-luat/",), "Pháp luật"),
    ("link", ("/giao-duc/",), "Giáo dục"),
    ("link", ("/suc-khoe/",), "Sức khỏe"),
    ("link", ("/gia-dinh/",), "Đời sống"),
    ("link", ("/du-lich/",), "Du lịch"),
    ("link", ("/khoa-hoc/",), "Khoa học"),
    ("link", ("/so-hoa/", "/suc-manh-so/"), "Số hóa"),
    ("link", ("/oto-xe-may/", "/xe/"), "Xe"),
    ("link", ("/xa-hoi/",), "Xã hội"),
    ("link", ("/van-hoa/",), "Văn hóa"),
)
#: Category by title, first match wins, letter case ignored.
TITLE_CATEGORIES = (
    ("thời tiết|mưa|nắng|bão|áp thấp|nhiệt độ", "Thời tiết Việt Nam"),
    ("ukraine|nga|mỹ|trung quốc|israel|gaza|nato|eu|triều tiên|iran|quốc tế", "Thế giới"),
    ("hà nội|tp hcm|thành phố|tỉnh|quốc hội|chính phủ|bộ trưởng", "Thời sự"),
    ("kinh doanh|kinh tế|thị trường|chứng khoán|đầu tư|ngân hàng|giá vàng|bất động sản", "Kinh doanh"),
    ("sức khỏe|bệnh|y tế|bệnh viện|khám", "Sức khỏe"),
    ("thể thao|bóng đá|v-league|u23|vô địch|olympic", "Thể thao"),
    ("giải trí|showbiz|ca sĩ|diễn viên|phim|âm nhạc", "Giải trí"),
)

#: Labels of the 40 entity types, in the order of the types.
TYPE_LABELS = {
    "PERSON": "NHÂN_VẬT", "ORG": "TỔ_CHỨC", "LOC": "ĐỊA_ĐIỂM", "MONEY": "TIỀN_TỆ", "DATE": "NGÀY_THÁNG", "TIME": "THỜI_GIAN", "JOB": "CHỨC_DANH", "EVENT": "SỰ_KIỆN",
    "PRODUCT": "SẢN_PHẨM", "LAW": "LUẬT_PHÁP", "PERCENT": "PHẦN_TRĂM", "PHONE": "ĐIỆN_THOẠI", "EMAIL": "EMAIL", "URL": "LIÊN_KẾT", "AGE": "TUỔI_TÁC", "TEMPERATURE": "NHIỆT_ĐỘ",
    "QUANTITY": "SỐ_LƯỢNG", "SCORE": "TỶ_SỐ", "FACILITY": "CƠ_SỞ_HẠ_TẦNG", "VEHICLE": "PHƯƠNG_TIỆN", "AWARD": "GIẢI_THƯỞNG", "DISEASE": "DỊCH_BỆNH", "SPORT_TEAM": "ĐỘI_BÓNG",
    "WORK_OF_ART": "TÁC_PHẨM", "LANGUAGE": "NGÔN_NGỮ", "NATIONALITY": "QUỐC_TỊCH", "CRYPTO": "TIỀN_ẢO", "ADDRESS": "ĐỊA_CHỈ", "IDENTIFIER": "MÃ_ĐỊNH_DANH", "STOCK_TICKER": "MÃ_CỔ_PHIẾU",
    "INDEX": "CHỈ_SỐ", "ORDINAL": "SỐ_THỨ_TỰ", "CARDINAL": "SỐ_ĐẾM", "DURATION": "KHOẢNG_THỜI_GIAN", "HASHTAG": "HASHTAG", "USERNAME": "TÊN_TÀI_KHOẢN", "TOPIC": "CHỦ_ĐỀ",
    "ACTION": "HÀNH_ĐỘNG", "TREND": "XU_HƯỚNG", "STATE": "TRẠNG_THÁI",
}
ATTRIBUTE_LABELS = {"TREND": "XU_HƯỚNG", "STATE": "TRẠNG_THÁI"}
NO_TYPE, NO_ATTRIBUTE = "CHƯA_XÁC_ĐỊNH", "THUỘC_TÍNH"

ANCHOR_TYPES = "PERSON ORG LOC JOB EVENT PRODUCT LAW FACILITY VEHICLE AWARD DISEASE SPORT_TEAM WORK_OF_ART LANGUAGE NATIONALITY CRYPTO STOCK_TICKER INDEX TOPIC".split()
SUPPORTING_TYPES = "MONEY DATE TIME PERCENT PHONE EMAIL URL AGE TEMPERATURE QUANTITY SCORE ADDRESS IDENTIFIER ORDINAL CARDINAL DURATION HASHTAG USERNAME".split()
WEAK_TYPES = ["ACTION", "TREND", "STATE"]
#: Types that become nodes of the graph (fixed values).
GRAPH_TYPES = "PERSON ORG LOC MONEY DATE TIME EVENT PRODUCT LAW PERCENT TEMPERATURE SCORE FACILITY VEHICLE AWARD DISEASE SPORT_TEAM WORK_OF_ART LANGUAGE NATIONALITY CRYPTO ADDRESS IDENTIFIER STOCK_TICKER INDEX TOPIC".split()
GENERIC_ANCHORS = ("việt nam", "vn", "thế giới", "quốc tế", "trong nước", "ngoài nước")
GENERIC_FOCUS = ("việt nam", "vn", "thế giới", "quốc tế", "tình hình", "hiện nay", "hôm nay", "hôm qua", "ngày mai")
TOPIC_SINGLES = frozenset({"ai", "giá", "thuế"})
SHORT_TERMS = frozenset({"ai", "gpt", "llm", "covid"})
TOPIC_BLOCKED = frozenset({"chuyên gia", "khu vực", "kết quả", "triển lãm", "triệu usd", "tuy nhiên", "đặc biệt", "đồng thời", "thế giới", "hội nghị thượng đỉnh"})
ALIASES = (
    ("tp hcm", "tp hồ chí minh", "thành phố hồ chí minh", "hồ chí minh", "sài gòn"),
    ("mỹ", "hoa kỳ", "usa", "united states"),
    ("anh", "vương quốc anh", "uk", "united kingdom"),
    ("việt nam", "vn"),
    ("trí tuệ nhân tạo", "artificial intelligence"),
    ("vn index", "vn-index"),
    ("s p 500", "s&p 500"),
)
QUERY_STOPWORDS = frozenset(
    "ai gì nào sao vì tại ở đâu khi bao giờ như thế có không chưa đã đang sẽ vừa mới tin là của cho với về trong ngoài trên dưới từ đến vào ra và hoặc hay nhưng mà thì do bởi theo này kia đó ấy "
    "một các những mọi rồi còn vẫn lại đều luôn rất quá hơn nhất đây đi chơi nhiêu".split()
)
#: Function words that cleaning drops.
STOPWORDS = frozenset(
    "và của là có được cho trong với các những một không này đó khi thì mà cũng như từ đến ra vào về trên dưới sau trước đã đang sẽ bị bởi do nên nếu vì để hay hoặc nhưng còn lại rất nhiều theo tại".split()
)
#: Compounds that tokenising joins.
COMPOUNDS = (
    "học sinh", "sinh viên", "giáo viên", "công nghệ", "thông tin", "kinh tế", "việt nam", "thế giới", "thời tiết", "dự báo", "trí tuệ", "nhân tạo", "xe hơi", "ô tô", "giá vàng",
    "bất động sản", "thành phố", "hà nội", "tp.hcm", "sài gòn", "đà nẵng",
)
INTENTS = (
    ("WHO", "ai|người nào|đơn vị nào|tổ chức nào"),
    ("WHAT", "gì|việc gì|điều gì|cái gì"),
    ("WHERE", "ở đâu|tại đâu|nơi nào|đâu"),
    ("WHEN", "khi nào|bao giờ|lúc nào"),
    ("WHY", "vì sao|tại sao|do đâu"),
    ("HOW", "như thế nào|ra sao|bằng cách nào"),
    ("YES_NO", "có không|không|chưa"),
)
NO_INFO = (
    "không tìm thấy thông tin", "không tìm thấy dữ liệu", "chưa tìm thấy thông tin", "không có thông tin", "không nhắc tới", "không nhắc đến", "không đề cập", "không tìm thấy",
    "chưa có thông tin", "i could not find", "cannot find",
)
WEATHER_PHRASES = ("nhiệt độ", "thời tiết", "mưa dông", "nắng nóng")
BRANDS = (
    "vnexpress", "dân trí", "dantri", "vietnamnet", "tuổi trẻ", "tuoi tre", "thanh niên", "thanh nien", "lao động", "lao dong", "nhân dân", "nhan dan", "vov", "vtv", "vtc",
    "reuters", "ap", "afp", "bbc", "cnn", "bloomberg", "zing", "znews",
)
NOISE_TAGS = ("script", "style", "iframe", "ins", "nav", "footer", "header", "aside", "form", "button")
#: Lower-case Vietnamese letters with marks.
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
