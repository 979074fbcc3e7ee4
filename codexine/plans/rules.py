"""Term lists of the query planner, over folded text. Terms stand anywhere in the text, also inside words.

All lists in this module are fixed values.
"""

STATUTORY_CAP = (("muc phat tien toi da",), ("ca nhan", "to chuc", "doi tuong"), ("hanh vi nao", "cao nhat", "nang nhat", "top", "xep hang", "thong ke", "tong hop"))

BEHAVIOURS = {
    "underage_license": ("rule", ("chua du tuoi", "khong du tuoi", "chua du 18", "duoi 18", "17 tuoi", "nguoi 17", "phan khoi lon", "gplx hang a", "giay phep lai xe hang a")),
    "red_light": ("penalty", ("vuot den do", "khong chap hanh tin hieu den", "den tin hieu giao thong")),
    "alcohol": ("penalty", ("say xin", "hoi con", "nong do con", "ruou bia", "co con cao")),
    "helmet": ("penalty", ("khong doi mu", "mu bao hiem")),
    "wrong_way": ("penalty", ("nguoc chieu", "duong nguoc chieu", "duong cam", "cam di nguoc chieu", "p102", "p.102")),
    "speed": ("penalty", ("vi pham toc do", "qua toc do", "chay qua toc", "vuot toc", "p127", "p.127")),
    "phone": ("penalty", ("dien thoai", "thiet bi am thanh", "dung tay cam va su dung dien thoai")),
    "drug": ("penalty", ("ma tuy", "chat ma tuy", "chat kich thich")),
    "three_passengers": ("penalty", ("cho theo tu 03", "cho theo 03", "cho 3 nguoi", "cho ba nguoi")),
    "accident": ("penalty", ("gay tai nan", "tai nan cho nguoi khac", "tai nan giao thong")),
}

TERMS = {
    "ranking": ("cao nhat", "thap nhat", "nang nhat", "nhe nhat", "lon nhat", "nho nhat", "toi da", "toi thieu", "top", "xep hang", "thong ke", "tong hop", "nhieu nhat", "it nhat", "hay vi pham", "pho bien nhat", "thuong gap"),
    "ranking_target": ("muc phat", "phat tien", "tru diem", "tuoc", "dieu luat", "dieu nao", "hanh vi", "vi pham", "bien bao"),
    "catalog": ("cac hanh vi", "nhung hanh vi", "hanh vi nao", "danh sach hanh vi", "toan bo hanh vi", "liet ke hanh vi"),
    "sanction": ("tuoc", "tru diem", "tich thu", "tam giu", "hinh phat bo sung", "hinh thuc xu phat bo sung"),
    "about_system": ("truy xuat", "he thong chi co top", "chi co top", "top k nho", "top-k nho"),
    "sign": ("bien bao", "bien cam", "bien hieu lenh", "bien chi dan", "vach ke duong", "hinh dang", "mau sac", "qcvn 41"),
    "not_table": ("bang hieu", "bang ten", "bang lai", "bang a1", "bang a2", "bang b", "bang c", "bang d", "bang e", "bang gplx", "bang giay phep lai xe", "tuoc bang"),
    "table": ("bang phu luc", "bang trong phu luc", "tra bang", "bang thong so", "bang quy chuan", "dong cot", "dong du lieu", "cot du lieu", "tong so gio", "tong thoi gian dao tao"),
    "document": ("nghi dinh", "nd ", "luat", "thong tu", "qcvn", "168/2024", "168-2024", "336/2025", "336-2025", "35/2024", "36/2024", "51/2024"),
    "overview": ("bao nhieu dieu", "may dieu", "so dieu", "tong so dieu", "danh sach dieu", "co nhung dieu", "gom nhung dieu", "bao nhieu chuong", "may chuong", "cau truc van ban"),
    "detail": ("chi tiet", "toan van", "day du", "noi dung", "quy dinh gi", "noi gi", "phan tich dieu", "tom tat dieu"),
    "source_image": ("hinh anh", "trang goc", "van ban goc", "can cu goc", "file goc", "scan", "crop"),
    "priority": ("xe uu tien", "quyen uu tien", "uu tien", "nhuong duong", "cuu thuong", "chua chay", "cong an", "quan su", "doan xe"),
    "scenario": ("tinh huong", "truong hop", "neu", "khi", "dang", "tham gia giao thong", "sau do", "dong thoi", "cung luc", "nga tu", "giao nhau", "vong xuyen"),
    "penalty": ("phat", "xu phat", "muc phat", "bao nhieu tien", "tru diem", "tuoc", "tam giu", "bi gi", "xu ly", "vi pham"),
    "procedure": ("thu tuc", "ho so", "trinh tu", "cap giay phep", "dang ky", "kiem dinh"),
    "definition": ("la gi", "khai niem", "dinh nghia", "nghia la gi"),
    "rule": (
        "co duoc", "duoc phep", "quy dinh", "trach nhiem", "di vao", "lan duong", "den do", "nguoc chieu", "dung xe", "do xe", "vuot", "chua du tuoi", "khong du tuoi",
        "giay phep lai xe", "gplx", "phan khoi lon", "nong do con", "hoi con", "say xin", "mu bao hiem", "tai nan",
    ),
    "license": ("giay phep lai xe", "gplx", "diem lai xe"),
    "license_points": ("bao nhieu diem", "so diem", "tong diem", "co may diem"),
    "in_scope": (
        "giao thong", "duong bo", "xe", "o to", "mo to", "xe may", "bien bao", "den do", "toc do", "gplx", "giay phep lai xe", "nong do con", "tai nan", "nghi dinh 168", "nghi dinh 336",
        "qcvn", "luat trat tu", "luat duong bo", "thong tu 35", "thong tu 51",
    ),
    "unrelated": (
        "nau an", "nau pho", "mon an", "thoi tiet", "gia vang", "chung khoan", "lap trinh", "python", "javascript", "bong da", "lich thi dau", "du lich", "khach san", "y te", "thuoc", "benh",
        "hon nhan", "ly hon", "dat dai", "hop dong lao dong",
    ),
    "legal_words": ("phat", "xu phat", "vi pham", "quy dinh", "thu tuc", "ho so", "dieu luat"),
    "legal_sources": ("luat", "nghi dinh", "thong tu", "quy chuan", "can cu"),
    "vehicle": ("o to", "xe hoi", "xe con", "xe tai", "xe khach", "xe may", "mo to", "gan may", "may chuyen dung", "xe dap", "tho so"),
}

#: Of several facets the first of these is the intent.
INTENTS = ("out_of_scope", "document_overview", "legal_detail", "aggregation", "penalty", "priority", "scenario", "definition", "procedure", "sign", "table")

MODALITIES = {"sign": ("sign", "figure"), "table": ("table",), "source_image": ("image", "figure", "table")}

SALIENCE = (
    (3, ("o to", "xe may", "mo to", "gan may", "xe dap", "may chuyen dung", "phuong tien")),
    (4, ("phat", "xu phat", "tru diem", "tuoc", "tam giu", "vi pham")),
    (4, ("den do", "toc do", "nong do con", "mu bao hiem", "nguoc chieu", "dien thoai", "tai nan")),
    (3, ("bien bao", "vach", "p127", "p.127", "qcvn")),
    (3, ("sau do", "dong thoi", "cung luc", "tinh huong", "truong hop", "nga tu", "giao nhau")),
    (2, ("hoi", "can tra cuu", "bao nhieu", "co duoc", "the nao", "phai lam gi")),
)

#: Articles of each vehicle group, and retrieval budgets by difficulty as (least score, contexts, graph depth, expected seconds).
VEHICLE_ARTICLES = {"car": ("6", "13"), "motorbike": ("7", "14"), "specialized": ("8", "15"), "bicycle": ("9",)}
EXPECTED_SECONDS = {"fast": (25, 45, 75), "deep": (30, 55, 90), "balanced": (30, 60, 105)}
DIFFICULTY = (("hard", 5), ("medium", 3))

#: What a search takes a question's behaviours from, and which texts then count: name, terms of questions, terms of texts.
SEARCHED = (
    ("red_light", ("vuot den do", "khong chap hanh tin hieu den", "den tin hieu"), ("khong chap hanh hieu lenh cua den tin hieu",)),
    ("alcohol", ("nong do con", "hoi con", "say xin", "ruou bia", "uong ruou", "ruou", "co con cao"), ("nong do con", "hoi tho co nong do con", "mau hoac hoi tho")),
    ("speed", ("vi pham toc do", "qua toc", "chay qua toc", "vuot toc", "p127", "p.127"), ("chay qua toc do", "qua toc do quy dinh", "toc do quy dinh")),
    ("helmet", ("khong doi mu", "mu bao hiem"), ("mu bao hiem", "khong cai quai dung quy cach")),
    ("drug", ("ma tuy", "chat ma tuy", "chat kich thich"), ("chat ma tuy", "chat kich thich", "trong co the co chat ma tuy")),
    ("phone", ("dien thoai", "thiet bi am thanh"), ("su dung dien thoai", "thiet bi am thanh", "dung tay cam va su dung dien thoai")),
    ("three_passengers", ("cho theo tu 03", "cho theo 03", "cho 3 nguoi", "cho ba nguoi"), ("cho theo tu 03 nguoi tro len", "cho ba nguoi", "cho theo 03 nguoi")),
    ("expressway_entry", ("di vao duong cao toc", "vao duong cao toc", "vao cao toc"), ("di vao duong cao toc", "duong cao toc")),
    ("no_license", ("khong co giay phep lai xe", "khong co gplx", "khong co bang lai", "khong bang lai", "chua co bang lai"), ("khong co giay phep lai xe", "giay phep lai xe da bi tru het diem")),
    ("wrong_way", ("nguoc chieu", "duong cam", "cam di nguoc chieu", "p102", "p.102"), ("di nguoc chieu cua duong mot chieu", "di nguoc chieu tren duong co bien", "duong co bien cam di nguoc chieu", "duong mot chieu, di nguoc chieu")),
    ("accident", ("gay tai nan", "tai nan giao thong", "tai nan cho nguoi khac"), ("gay tai nan giao thong", "khong giu nguyen hien truong", "khong tro giup nguoi bi nan")),
)

#: Names by which questions call documents: the document, its names, all documents that are meant.
DOCUMENTS = (
    ("Nghị định 168/2024/NĐ-CP", ("nghi dinh 168", "nghi dinh so 168", "nd 168", "168/2024", "168-2024"), ("Nghị định 168/2024/NĐ-CP",)),
    ("Nghị định 336/2025/NĐ-CP", ("nghi dinh 336", "nghi dinh so 336", "nd 336", "336/2025", "336-2025"), ("Nghị định 336/2025/NĐ-CP",)),
    ("Luật Đường bộ 2024", ("luat duong bo", "35/2024/qh15", "35-2024-qh15", "luat 35"), ("Luật Đường bộ 2024",)),
    ("Luật Trật tự ATGT 2024", ("luat trat tu", "trat tu an toan giao thong", "36/2024/qh15", "36-2024-qh15", "luat 36"), ("Luật Trật tự ATGT 2024", "Luật Trật tự ATGT 2024 (Tiếp)")),
    ("QCVN 41:2024 (Thông tư 51/2024)", ("qcvn 41", "thong tu 51", "51/2024", "51-2024", "quy chuan 41", "quy chuan ve bao hieu duong bo", "quy chuan bbdb"), ("QCVN 41:2024 (Thông tư 51/2024)",)),
    ("Thông tư 35/2024/TT-BGTVT", ("thong tu 35", "35/2024/tt-bgtvt", "35-2024-tt-bgtvt"), ("Thông tư 35/2024/TT-BGTVT",)),
)
PENALTY_DOCUMENT = "Nghị định 168/2024/NĐ-CP"
#: Terms of road works and services that, in a question on penalties, mean the second decree.
SERVICES_DOCUMENT = "Nghị định 336/2025/NĐ-CP"
SERVICES = (
    "hoat dong duong bo", "hanh lang an toan duong bo", "dat danh cho ket cau ha tang", "ket cau ha tang duong bo", "pham vi bao ve ket cau", "duong bo dang khai thac", "ham duong bo", "gam cau",
    "mai duong", "tram thu phi", "thu phi dien tu", "tai khoan giao thong", "the dau cuoi", "he thong thanh toan dien tu giao thong", "xe taxi", "xe buyt", "phan mem ket noi van tai",
    "cho thue phuong tien tu lai", "co so dao tao", "giang vien", "tham tra an toan giao thong", "thi cong tren duong bo", "lap thiet bi canh bao", "den canh bao",
    "ban giao ho so hoan thanh cong trinh", "chan tha gia suc", "dot lua", "cong chao", "bien quang cao", "thao do, di chuyen", "lam sai lech bien bao", "chu tich uy ban nhan dan cap xa", "ubnd cap xa",
    "giam doc cong an cap tinh", "tien hanh cac hoat dong ghi trong giay phep",
)
PENALTY_CONTEXT = ("hinh thuc xu phat", "tham quyen xu phat", "quyet dinh xu phat", "lap bien ban", "tuoc quyen su dung giay phep")
PENALTY_QUESTION = ("phat", "xu phat", "muc phat", "bi gi", "xu ly", "vi pham", "tru diem", "tuoc")
#: Terms that leave the vehicle open.
ANY_VEHICLE = ("xe", "phuong tien", "chay", "toc do", "bien", "p127", "p.127", "tat ca", "toan bo")
SPEED_QUESTION = ("toc do", "qua toc", "vuot toc", "p127", "p.127")
#: Vehicles by the terms of a question, in the order of their tests.
VEHICLES = (("specialized", ("may chuyen dung",)), ("motorbike", ("xe may", "mo to", "gan may")), ("car", ("o to", "xe hoi", "xe con", "xe tai", "xe khach")), ("bicycle", ("xe dap", "tho so")))
RULE_ARTICLES = {"car": "6", "motorbike": "7", "specialized": "8", "bicycle": "9"}

#: Words that a route adds to its questions.
ROUTE_WORDS = {
    "penalty": "mức phạt tiền trừ điểm giấy phép lái xe tước giấy phép xử phạt vi phạm",
    "table": "bảng phụ lục dòng cột thông số kỹ thuật quy chuẩn",
    "definition": "định nghĩa khái niệm được hiểu là giải thích từ ngữ phạm vi áp dụng điều khoản",
    "procedure": "thủ tục hồ sơ thời hạn thời gian cơ quan xử lý cấp đổi cấp lại sát hạch đào tạo giấy phép lái xe",
    "priority": "xe ưu tiên quyền ưu tiên tín hiệu ưu tiên nhường đường giao nhau vòng xuyến xe chữa cháy cứu thương công an quân sự",
    "scenario": "tình huống thực tế trường hợp điều kiện áp dụng hành vi chủ thể thời điểm trách nhiệm quy tắc xử lý",
    "source_image": "ảnh trang gốc hình bảng phụ lục scan văn bản gốc căn cứ trực quan",
    "sign": "QCVN 41 biển báo hình dạng ý nghĩa phụ lục hình biển báo",
}
#: Synonyms that a search adds: terms of the folded question (any of the first, and any of the second if there are some), words.
SYNONYMS = (
    (("xe may",), (), "xe mô tô xe gắn máy người điều khiển xe"),
    (("phan khoi lon",), (), "trên 125 cm3 công suất trên 11 kW giấy phép lái xe hạng A"),
    (("chua du tuoi", "khong du tuoi"), (), "độ tuổi người lái xe điều kiện điều khiển phương tiện"),
    (("vuot den do",), (), "không chấp hành tín hiệu đèn giao thông"),
    (("hoi con", "nong do con", "say xin"), (), "điều khiển xe trên đường mà trong máu hoặc hơi thở có nồng độ cồn"),
    (("toc do", "qua toc", "p127", "p.127"), (), "điều khiển xe chạy quá tốc độ quy định tốc độ tối đa cho phép"),
    (("khong doi mu",), (), "không đội mũ bảo hiểm cho người đi mô tô xe máy"),
    (("nguoc chieu",), (), "đi ngược chiều đường một chiều đi vào đường cấm"),
    (("cao toc",), ("xe may", "mo to", "gan may"), "điều khiển xe mô tô xe gắn máy đi vào đường cao tốc"),
    (("tai nan",), (), "gây tai nạn giao thông trách nhiệm người điều khiển phương tiện"),
    (("p.102", "p102"), (), "cấm đi ngược chiều đi vào đường cấm"),
    (("giay phep lai xe", "gplx", "diem lai xe"), ("bao nhieu diem", "so diem", "tong diem", "co may diem"), "Điều 58 điểm của giấy phép lái xe bao gồm 12 điểm"),
)
#: Marks of definitions, and of what scoring looks for.
DEFINITION_MARKS = ("giai thich tu ngu", "duoc hieu la", "bao gom", "khai niem", "dinh nghia")
DEFINITION_PATTERNS = (r"(.+?)\s+la\s+gi\b", r"khai niem\s+(.+)", r"dinh nghia\s+(.+)", r"(.+?)\s+duoc hieu la gi\b")
PENALTY_MARKS = ("phat tien", "tru diem", "tuoc quyen", "giay phep lai xe")
PRIORITY_MARKS = ("xe uu tien", "quyen uu tien", "uu tien", "nhuong duong", "tin hieu uu tien", "giao nhau", "vong xuyen")
SCENARIO_MARKS = (
    "nga tu", "giao nhau", "vong xuyen", "lan duong", "den do", "tin hieu den", "toc do", "nong do", "hoi con", "uu tien", "nguoc chieu", "mu bao hiem", "tai nan", "chua du tuoi", "khong du tuoi",
)
PROCEDURE_MARKS = (
    ("procedure_time_boost", ("thoi han", "hieu luc", "bao lau", "may nam", "ngay", "thang", "nam"), ("thoi han", "co thoi han", "hieu luc", "ngay", "thang", "nam"), 2.0),
    ("procedure_file_boost", ("ho so", "giay to", "don de nghi", "ban sao"), ("ho so", "don de nghi", "ban sao", "giay kham suc khoe"), 1.7),
    ("procedure_training_boost", ("dao tao", "tap lai", "hoc vien", "sat hach", "giay phep lai xe", "gplx"), ("dao tao", "tap lai", "hoc vien", "sat hach", "giay phep lai xe", "gplx"), 1.2),
)
LICENSE_QUESTION = ("chua du tuoi", "khong du tuoi", "duoi 18", "phan khoi lon", "hang a", "giay phep lai xe", "gplx")
LICENSE_CLASS = ("hang a cap", "tren 125 cm3", "tren 11 kw", "hang a1 cap")
DRIVER_AGE = ("do tuoi", "du 16 tuoi", "du 18 tuoi", "nguoi lai xe")

#: Retrieval budgets: profile, difficulty, contexts searched, graph depth, contexts of a slot, contexts, images.
BUDGETS = {
    "fast": {"hard": (28, 2, 8, 34, 12), "medium": (18, 1, 6, 22, 8), "easy": (12, 1, 4, 12, 5)},
    "deep": {"hard": (64, 5, 14, 90, 40), "medium": (24, 3, 7, 28, 18), "easy": (14, 2, 5, 16, 10)},
    "balanced": {"hard": (44, 3, 11, 60, 24), "medium": (24, 2, 7, 30, 12), "easy": (14, 1, 5, 16, 6)},
}
#: What makes a question complex: terms and what they add.
COMBINED = ("tong hop", "tong cong", "tong hau qua", "cong don", "vua", "dong thoi", "cung luc")
CONDITIONAL = ("neu", "truong hop", "so sanh", "khac nhau", "ngoai ra", "trong khi")
FACET_WEIGHTS = {"scenario": 2, "aggregation": 3, "priority": 2, "source_image": 1, "document_overview": 2, "legal_detail": 4}
#: Words that join the acts of one question, and what an act looks like.
JOINED = (" dong thoi ", " cung luc ", " vua ", " va ")
ACT_PHRASES = ("di vao", "khong doi", "khong chap hanh", "doi mu", "nong do", "su dung", "nhuong duong")
ACT_VERBS = r"\b(?:di|vuot|dung|do|re|quay|chay|uong)\b"
#: Phrases of answers that leave something open.
VAGUE_ANSWERS = ("phat tien theo quy dinh", "muc phat tien tham chieu", "tham chieu", "muc phat pho bien", "can doi chieu", "chua ro so tien", "phat tien: muc phat", "vui long cung cap loai phuong tien")
#: Terms of the hints on what a question leaves open.
HINT_PENALTY = ("phat", "xu phat", "muc phat", "vi pham", "bi gi", "xu ly", "tru diem", "tuoc")
HINT_MOVING = ANY_VEHICLE
HINT_SPEED = ("toc do", "qua toc", "vuot toc", "p127", "p.127")
HINT_ALCOHOL = ("nong do con", "hoi con", "ruou bia", "say xin", "co con")
HINT_FREQUENT = ("hay vi pham", "pho bien", "thuong gap")

#: Kinds of questions of a test set, in the order of their tests: kind, whether the question alone counts, terms in lower case.
CASE_KINDS = (
    ("DEFINITION", True, ("phạm vi điều chỉnh", "là gì", "bao gồm những gì", "được hiểu như thế nào")),
    ("SIGN_MEANING", False, ("biển báo",)),
    ("PENALTY", False, ("phạt", "tiền", "trừ điểm", "tước quyền", "đình chỉ")),
    ("PROCEDURE", False, ("hồ sơ", "thủ tục", "trình tự", "thời hạn", "nộp", "đăng ký", "cấp lại", "đổi giấy phép")),
    ("EXCEPTION", False, ("trừ trường hợp", "ngoại lệ", "không áp dụng", "trừ hành vi")),
    ("TABLE_LOOKUP", False, ("bảng",)),
)
