"""Declared types of what is read, extracted and stored; field names are part of the contract."""

from __future__ import annotations

VALIDATION = "STRUCT<status: STRING, checked: INT, issues: STRING>"
TABLE = f"STRUCT<page: INT, sheet_name: STRING, detection_method: STRING, headers: ARRAY<STRING>, matrix: ARRAY<ARRAY<STRING>>, markdown: STRING, table_confidence: DOUBLE, validation: {VALIDATION}>"
PAGE = "STRUCT<page: INT, method: STRING, sheet_name: STRING, text: STRING, confidence: DOUBLE, lines: ARRAY<STRING>, confidences: ARRAY<DOUBLE>, elements: ARRAY<STRUCT<type: STRING, text: STRING>>>"
PAIR = "STRUCT<line_index: INT, key: STRING, value: STRING, raw_line: STRING>"

#: What reading one document gives, as columns.
DOC_RESULT = (
    "original_filename STRING, file_path STRING, file_hash STRING, document_type STRING, source_type STRING, extraction_method STRING, category STRING, category_confidence DOUBLE, "
    "has_table BOOLEAN, total_pages INT, headers_detected ARRAY<STRING>, footers_detected ARRAY<STRING>, full_text STRING, "
    f"pages ARRAY<{PAGE}>, tables ARRAY<{TABLE}>, key_value_pairs ARRAY<{PAIR}>"
)

GOODS = "STRUCT<stt: INT, ten_hang: STRING, dvt: STRING, so_luong: DOUBLE, don_gia: DOUBLE, thanh_tien: DOUBLE>"
SERVICE = "STRUCT<stt: INT, ten_dich_vu: STRING, thoi_han: STRING, thanh_tien: DOUBLE>"
ASSET = "STRUCT<stt: DOUBLE, ten_tai_san: STRING, so_serial: ARRAY<STRING>, dvt: STRING, so_luong: INT, tinh_trang: STRING>"
_SIDE = "STRUCT<vai_tro: STRING, ten_to_chuc: STRING, dai_dien: STRING, chuc_vu: STRING, mst: STRING, dia_chi: STRING, dien_thoai: STRING, email: STRING, so_tai_khoan: STRING, ngan_hang: STRING>"
_UNIT = "STRUCT<ten_don_vi: STRING, dai_dien: STRING, chuc_vu: STRING, can_bo_ky_thuat: STRING, mst: STRING>"
_PERSON = "STRUCT<ho_ten: STRING, so_tai_khoan: STRING, ngan_hang: STRING>"

#: Key information of each kind of document.
RECORDS = {
    "invoice": "STRUCT<so_hoa_don: STRING, ky_hieu: STRING, mau_so: STRING, ngay_hoa_don: STRING, ma_cqt: STRING, ma_tra_cuu: STRING, "
    "ben_ban: STRUCT<ten: STRING, mst: STRING, dia_chi: STRING, so_tai_khoan: STRING, ngan_hang: STRING, dien_thoai: STRING>, "
    "ben_mua: STRUCT<ten: STRING, mst: STRING, dia_chi: STRING, nguoi_mua_hang: STRING, dien_thoai: STRING>, "
    f"danh_sach_hang_hoa: ARRAY<{GOODS}>, tai_chinh: STRUCT<tien_chua_thue: DOUBLE, thue_suat: INT, tien_thue_gtgt: DOUBLE, tong_tien_thanh_toan: DOUBLE, "
    "so_tien_bang_chu: STRING, loai_tien: STRING, hinh_thuc_thanh_toan: STRING>, ghi_chu: ARRAY<STRING>>",
    "contract": f"STRUCT<so_hop_dong: STRING, tieu_de: STRING, ngay_ky: STRING, ngay_hieu_luc: STRING, ben_a: {_SIDE}, ben_b: {_SIDE}, "
    "gia_tri_hop_dong: STRUCT<tong_tien: DOUBLE, tien_chua_vat: DOUBLE, tien_vat: DOUBLE, loai_tien: STRING, hinh_thuc_thanh_toan: STRING>, "
    f"dich_vu_chinh: ARRAY<{SERVICE}>, thoi_han_hop_dong: STRING, dieu_khoan_quan_trong: STRUCT<gia_han: STRING, dieu_kien_cham_dut: STRING, giai_quyet_tranh_chap: STRING>, nguoi_ky: ARRAY<STRING>>",
    "voucher": f"STRUCT<loai_chung_tu: STRING, so_chung_tu: STRING, ngay_lap: STRING, can_cu: STRING, dia_diem: STRING, ben_giao: {_UNIT}, ben_nhan: {_UNIT}, "
    f"danh_muc_tai_san: ARRAY<{ASSET}>, thoi_han_bao_hanh: STRING, ho_so_kem_theo: ARRAY<STRING>, nghia_vu_thanh_toan: STRUCT<tong_gia_tri: DOUBLE, da_thanh_toan: DOUBLE, con_lai: DOUBLE, chi_tiet_dot: ARRAY<STRING>>, "
    "ket_luan: STRING, nguoi_ky: ARRAY<STRING>>",
    "bank_transfer": f"STRUCT<trang_thai: STRING, so_tien: DOUBLE, loai_tien: STRING, thoi_gian_giao_dich: STRING, ma_giao_dich: STRING, nguoi_nhan: {_PERSON}, nguoi_gui: {_PERSON}, noi_dung: STRING, phi_giao_dich: DOUBLE>",
    "generic": "STRUCT<title: STRING, document_number: STRING, date: STRING, organizations: ARRAY<STRING>, people: ARRAY<STRING>, amounts: ARRAY<DOUBLE>, dates: ARRAY<STRING>, identifiers: ARRAY<STRING>, key_information: ARRAY<STRING>, description: STRING>",
}
#: Category of documents that have each kind of record.
CATEGORIES = {"invoice": "hoa_don", "contract": "hop_dong", "voucher": "chung_tu", "bank_transfer": "anh_chuyen_khoan"}
