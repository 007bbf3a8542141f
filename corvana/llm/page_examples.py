"""Labelled pages, written for this project, from which the page model of `main_text` takes its first potentials.

One string is a page, one line of it a line of the page after a mark: F furniture that a site repeats, f furniture
that is rare, S a paragraph of the story, s a heading, list, table or quotation of the story.
"""

PAGES = (
    """F Trang nhất | Kinh tế | Thể thao | Giáo dục | Ảnh
F Thứ tư, 3/4/2019
S Hội đồng xã đã thông qua kế hoạch sửa cây cầu gỗ bắc qua suối vào cuối mùa khô năm nay.
S Cây cầu gỗ được dựng từ hơn bốn mươi năm trước, nhiều thanh gỗ đã mục sau các đợt lũ lớn.
s Kế hoạch sửa cây cầu gỗ và nguồn vốn
S Theo ông Hải, nguồn vốn lấy từ ngân sách xã và tiền góp của người dân hai thôn.
F Có thể bạn chưa đọc
f - Đội trẻ giành vé vào chung kết giải tỉnh
f » Giá cà phê tăng phiên thứ ba liên tiếp
f 3 Bệnh viện huyện nhận thêm máy chụp cắt lớp
S Dự kiến cây cầu gỗ sẽ thông xe trước tháng mười, trước khi mùa lũ bắt đầu.
f Nguyễn Văn Hải
F Bản quyền thuộc tòa soạn. Không sao chép khi chưa được phép.
F Lên đầu trang""",
    """F Website này lưu cookie để phục vụ bạn tốt hơn. Đồng ý / Từ chối
F Trang nhất › Giáo dục › Tuyển sinh
f (Trần Thị Mai)
S Kỳ thi vào lớp mười năm nay có thêm môn thứ ba, thí sinh làm bài trong ba buổi.
F Quảng cáo
S Môn thứ ba được công bố vào cuối tháng ba, các trường có hai tháng để ôn tập.
s 1. thí sinh nhận phòng thi vào buổi chiều
s 2. thí sinh nộp bài sớm được ra khỏi phòng
s 3. môn thứ ba thi trắc nghiệm
S “Đề thi bám sát chương trình, thí sinh không cần lo lắng”, cô Mai nói với phóng viên.
F Tin cùng mục
f Trường nghề mở thêm ngành hàn công nghệ cao
f Thư viện thành phố mở cửa buổi tối
f - Sinh viên năm cuối được vay vốn không lãi
F 12 bình luận
F Gửi ý kiến của bạn
F Đường dây nóng: 0123 456 789""",
    """F Báo mới › Thể thao › Bóng bàn
f Phóng viên Lê Quốc Anh
S Tay vợt số một của tỉnh thắng cả bốn ván trong trận ra quân sáng chủ nhật.
S Đối thủ của anh dẫn trước ở ván thứ hai nhưng mắc lỗi giao bóng liên tiếp.
F Đọc thêm
f 5 Cơn mưa lớn làm ngập tuyến đường ven hồ
f Ngân hàng giảm lãi suất cho vay mua nhà
f » Vở chèo cổ được dựng lại sau nửa thế kỷ
s Trận ra quân và lịch thi đấu
S Vòng bảng kéo dài sáu ngày, mỗi tay vợt đấu ba trận trước khi vào vòng loại trực tiếp.
s tay vợt Bình | 3 | 11
s tay vợt Sơn | 2 | 9
s tay vợt Khoa | 1 | 7
f Ảnh: Phạm Minh Đức
F Chia sẻ: Thư điện tử, Sao chép liên kết
F Theo dõi kênh của báo (1204 người theo dõi)
F © 2019 Báo mới. Mọi quyền được bảo lưu.""",
    """S Giá lúa tại ruộng giảm nhẹ trong tuần qua do thương lái chờ hợp đồng xuất khẩu mới.
S Nông dân ở ba xã ven sông cho biết lúa đã chín rộ nhưng máy gặt chưa về kịp.
s Lúa chín rộ ở ba xã ven sông
S Hợp tác xã đang liên hệ thêm máy gặt từ huyện bên, giá thuê tăng một phần mười.
s • máy gặt từ huyện bên về trong tuần
s • lúa ướt được sấy tại kho hợp tác xã
s • thương lái trả thêm cho lúa khô
F Tiếp tục đọc bên dưới
S Nếu trời không mưa, ba xã sẽ gặt xong trước ngày hai mươi.
f Theo Hoàng Thị Lan
F Giấy phép số 45/GP do sở cấp""",
    """F Thể thao
F Kinh tế
F Sức khỏe
F Thứ hai, 5/8/2020
S Bác sĩ khuyên người cao tuổi tiêm phòng cúm trước khi trời chuyển lạnh ít nhất hai tuần.
S Mũi tiêm phòng cúm cần nhắc lại mỗi năm vì vi rút cúm thay đổi theo mùa.
s Bước 1: người cao tuổi đăng ký tiêm phòng tại trạm y tế
s Bước 2: bác sĩ đo huyết áp trước khi tiêm
s Bước 3: người cao tuổi ngồi lại theo dõi nửa giờ
S Trạm y tế xã nhận đăng ký cả ngày thứ bảy.
F Xem thêm
f - Tàu cao tốc chạy thử đoạn qua đèo
f - Công an bắt nhóm làm giả giấy tờ xe
f Đoàn làm phim trở lại phố cổ sau hai năm
F Đăng nhập để gửi bình luận
F Nhận bản tin mỗi tối
f Biên soạn: Đỗ Thanh Tùng
F Chịu trách nhiệm xuất bản: Ban thư ký""",
    """f Bài: Vũ Ngọc Hà | Ảnh: Tư liệu
S Ngọn hải đăng cũ trên đảo được sơn lại và mở cửa cho khách lên ngắm biển.
S Khách lên đảo bằng tàu gỗ, mỗi chuyến mất chừng bốn mươi phút nếu biển lặng.
F Nội dung tài trợ
F Tải ứng dụng đọc báo
s Ngọn hải đăng cũ và chuyến tàu gỗ
S “Đứng trên ngọn hải đăng cũ có thể thấy cả vịnh”, người gác đèn kể.
S Mùa này biển lặng, mỗi ngày có hai chuyến tàu ra đảo.
F Mới nhất
f 2 Sở giao thông điều chỉnh luồng xe tải vào nội đô
f Nhà khoa học trẻ nhận học bổng nghiên cứu sao băng
f » Tòa án hoãn phiên xử vụ tranh chấp đất
f Lê Thu Trang (tổng hợp)
F Tòa soạn: số 15 đường Bờ Sông
F Phiên bản di động""",
    """F Trang nhất / Công nghệ / Phần mềm
S Nhóm kỹ sư trẻ vừa phát hành bản vá cho bộ gõ chạy trên điện thoại đời cũ.
S Bản vá giúp bộ gõ dùng ít bộ nhớ hơn và không còn treo khi đổi bàn phím.
S “Chúng tôi viết lại phần xử lý dấu để bộ gõ chạy nhanh hơn”, trưởng nhóm nói.
F [Quảng cáo]
s Bộ gõ mới trên điện thoại đời cũ
S Người dùng có thể tải bản vá từ kho ứng dụng trong tuần này.
f Tác giả: Bùi Gia Khánh
F Thích trang của chúng tôi để không bỏ lỡ tin mới
F Bạn cần đăng nhập để bình luận
F Ghi rõ nguồn khi phát hành lại
F Liên hệ quảng cáo: ads@bao.example""",
    """S Đàn cò trắng trở lại khu rừng ngập mặn sau ba năm vắng bóng.
S Người giữ rừng đếm được hơn hai trăm con cò trong buổi sáng đầu tiên.
s - đàn cò làm tổ trên ngọn bần
s - rừng ngập mặn được trồng thêm năm ngoái
s - người giữ rừng dựng chòi quan sát
S Chính quyền cấm thuyền máy vào khu rừng trong mùa cò làm tổ.
F Tin liên quan
f - Chợ phiên vùng cao đông khách dịp cuối năm
f 4 Đội tuyển bóng chuyền tập trung đợt mới
f Học phí đại học tăng theo lộ trình
s Khu rừng ngập mặn và mùa cò làm tổ
S Khu rừng rộng gần ba trăm héc ta, là nơi trú của nhiều loài chim nước.
F Về đầu trang
F Bản đầy đủ""",
    """F Chọn cỡ chữ A A+ · Nghe bài
S Phiên tòa sáng nay tuyên phạt bị cáo bảy năm tù vì làm giả con dấu của doanh nghiệp.
S Bị cáo khai đã bán hơn ba mươi con dấu giả cho các cửa hàng trên mạng.
S Luật sư đề nghị giảm nhẹ vì bị cáo thành khẩn và đã nộp lại toàn bộ số tiền.
F Đọc nhiều
f » Mưa đá làm hỏng vườn mận ở xã biên giới
f Nhạc sĩ trẻ ra mắt tập ca khúc thiếu nhi
f - Xe buýt điện chạy thử tuyến sân bay
S Viện kiểm sát cho biết sẽ không kháng nghị bản án.
f Đồ họa: Mai Chí Công
f Theo Thông tấn Miền Trung
F Hãy là người bình luận đầu tiên
F Toàn bộ nội dung được bảo hộ""",
)
