"""Texts labelled by hand, for calibration: 1 is junk (lists, tables, codes, fragments), 0 is natural prose.

HOLDOUT are whole texts of our own. HELD are the first 170 documents of a 10,000-document collection in the order of
md5("h" + doc_id), labelled one by one from their first 95 and last 28 characters and their numbers of words and lines; one label,
"table after a paragraph", was set after its statistics had been seen. Kept are the five statistics (word count, mean word
length, symbol ratio, share of lines ended, share of common words), the label, and what the text is.
"""

HOLDOUT = [
    ("The council met on Tuesday to discuss the new bus routes, and most of the people who spoke were in favour of them. A decision is due in the spring.", 0),
    ("I do not think that we should ban cars from the centre at once. It would be better to start with one street and see how the shops and the people who live there get on with it.", 0),
    ("My grandmother kept bees behind the house for forty years. She said that the secret was to leave them alone, and to talk to them when somebody in the family had died.", 0),
    ("There is no proof that longer lessons help children to learn more. What the studies show is that it depends on the teacher, and on how the time is used.", 0),
    ("When the river rose for the third time that winter, nobody was surprised. We carried the chairs up to the first floor and waited for the water to go down again!", 0),
    ("Why should we pay for a road that only a few of us will use? This is the question which the mayor could not answer at the meeting, and it is a good one.", 0),
    ("He was not the kind of man who would ask for help. So it was a week before anyone in the office knew that he had been sleeping in his car.", 0),
    ("Wir haben lange darüber gesprochen, ob die Schule in der Stadt bleiben soll. Am Ende war es nicht das Geld, das den Ausschlag gab, sondern der Weg für die Kinder.", 0),
    ("Es ist nicht so, dass die neue Regel allen schadet. Aber sie hilft auch nicht denen, für die sie gemacht wurde, und das ist der Grund, warum ich gegen sie bin.", 0),
    ("Je ne crois pas que la loi soit mauvaise en elle-même. Mais elle est arrivée trop tard pour les gens qui en avaient besoin, et c'est ce que nous devons dire au conseil.", 0),
    ("La maison est vide depuis que les voisins sont partis pour le sud. On dit que la ville va la vendre, mais personne ne sait à quel prix ni dans quel état.", 0),
    ("No es verdad que los jóvenes no quieran trabajar en el campo. Lo que pasa es que no hay tierra para ellos, y que los que la tienen no la quieren dejar.", 0),
    ("El tren de la mañana llega siempre tarde, pero a nadie le importa porque todos los que lo toman se conocen y hablan de sus cosas hasta que llega.", 0),
    ("We were told that the bridge would be open by May. It is now October, and the only thing that has changed is the date on the sign. Who is to blame for that?", 0),
    ("name;id;price;stock\nbolt M4;00213;0.12;4000\nbolt M5;00214;0.14;3500\nnut M4;00301;0.05;9000\nnut M5;00302;0.06;8700\nwasher;00410;0.02;12000", 1),
    ("| year | north | south |\n|------|-------|-------|\n| 2019 | 12.4 | 9.8 |\n| 2020 | 11.1 | 10.2 |\n| 2021 | 13.0 | 10.9 |", 1),
    ("Home > Products > Garden > Hoses\nLogin | Register | Cart (0)\nSort by: price | name | date\n1 2 3 4 5 ... 18 next >>", 1),
    ("aGVsbG8gd29ybGQsIHRoaXMgaXMgYSBsb25nIHN0cmluZyBvZiBiYXNlNjQgdGhhdCBtZWFucyBub3RoaW5nIGF0IGFsbA==", 1),
    ("$$$ !!! WIN WIN WIN !!! $$$ >>> http://x.example/?a=1&b=2&c=3 <<< $$$ !!! FREE FREE FREE !!! $$$", 1),
    ("ERROR 2023-04-01T12:00:01Z [worker-3] java.lang.NullPointerException\n\tat a.b.C.d(C.java:41)\n\tat a.b.C.e(C.java:77)\n\tat a.b.F.g(F.java:12)", 1),
    ("milk\neggs\nbread\nbutter\nwashing powder\n2 x tomatoes\npaper towels\nlight bulbs", 1),
    ("a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 0", 1),
    ("{\"id\": 17, \"tags\": [\"x\", \"y\"], \"geo\": {\"lat\": 48.1, \"lon\": 11.5}, \"ok\": true, \"n\": null}", 1),
    ("if (x[i] != y[j]) { k += 1; } else { k -= 1; }\nfor (i = 0; i < n; i++) { s += x[i]; }\nreturn s / (n + 1);", 1),
    ("0041 7734 9920 1182 5530 7761 9001 4412 8830 1127 6654 3321 9987 1200 4456 7781", 1),
    ("ok", 1),
    ("", 1),
    ("+++ --- +++ --- === *** === *** ### ### ///", 1),
    ("xkvjq zzrtp wqlmn bcdfg hjklm npqrs tvwxz kkjjh ggffd sswwq ppllm nnbbv ccxxz qqwrt zzxxc vvbbn mmkkj hhggf ddssa qqwwr", 1),
    ("Tel.: 089/555-1234 * Fax: 089/555-1235 * Mo-Fr 8-18 * Sa 9-13 * www.shop.example", 1),
]

HELD = [
    (334, 4.686, 0.027, 1.0, 0.536, 0, "prose"),
    (110, 4.927, 0.017, 1.0, 0.391, 0, "prose"),
    (246, 4.854, 0.022, 1.0, 0.407, 0, "prose"),
    (262, 5.076, 0.02, 1.0, 0.405, 0, "prose"),
    (141, 4.929, 0.017, 1.0, 0.383, 0, "prose"),
    (813, 4.937, 0.021, 1.0, 0.407, 0, "prose"),
    (53, 4.585, 0.021, 1.0, 0.472, 0, "prose"),
    (94, 5.032, 0.013, 1.0, 0.394, 0, "prose"),
    (144, 5.146, 0.022, 1.0, 0.41, 0, "prose"),
    (58, 5.0, 0.493, 0.0, 0.0, 1, "spam"),
    (78, 5.731, 0.031, 1.0, 0.41, 0, "prose"),
    (111, 5.054, 0.021, 1.0, 0.351, 0, "prose"),
    (164, 4.817, 0.02, 0.176, 0.421, 0, "prose"),
    (157, 4.65, 0.015, 1.0, 0.433, 0, "prose"),
    (155, 5.161, 0.018, 1.0, 0.394, 0, "prose"),
    (306, 4.709, 0.022, 1.0, 0.405, 0, "prose"),
    (158, 5.063, 0.019, 1.0, 0.43, 0, "prose"),
    (185, 4.724, 0.023, 1.0, 0.395, 0, "prose"),
    (31, 16.29, 0.925, 0.0, 0.161, 1, "symbols"),
    (340, 4.962, 0.02, 1.0, 0.406, 0, "prose"),
    (679, 5.009, 0.018, 1.0, 0.404, 0, "prose"),
    (43, 4.651, 0.025, 1.0, 0.512, 0, "prose"),
    (83, 4.627, 0.023, 1.0, 0.422, 0, "prose"),
    (162, 4.864, 0.016, 1.0, 0.407, 0, "prose"),
    (35, 3.486, 0.139, 0.0, 0.0, 1, "menu"),
    (168, 4.869, 0.02, 1.0, 0.44, 0, "prose"),
    (426, 4.925, 0.02, 1.0, 0.387, 0, "prose"),
    (85, 5.082, 0.023, 1.0, 0.4, 0, "prose"),
    (183, 4.831, 0.026, 1.0, 0.415, 0, "prose"),
    (106, 4.396, 0.021, 1.0, 0.547, 0, "prose"),
    (66, 5.258, 0.017, 1.0, 0.424, 0, "prose"),
    (97, 5.289, 0.027, 1.0, 0.485, 0, "prose"),
    (197, 4.563, 0.024, 1.0, 0.533, 0, "prose"),
    (260, 4.985, 0.025, 1.0, 0.462, 0, "prose"),
    (292, 4.894, 0.016, 1.0, 0.404, 0, "prose"),
    (19, 14.105, 0.91, 0.0, 0.158, 1, "symbols"),
    (82, 5.049, 0.017, 1.0, 0.39, 0, "prose"),
    (67, 4.896, 0.067, 0.0, 0.0, 1, "list"),
    (343, 4.886, 0.023, 1.0, 0.397, 0, "prose"),
    (25, 5.0, 0.144, 0.0, 0.0, 1, "record"),
    (74, 4.689, 0.02, 1.0, 0.392, 0, "prose"),
    (24, 13.583, 0.905, 0.0, 0.25, 1, "symbols"),
    (20, 4.55, 0.011, 1.0, 0.6, 0, "prose"),
    (42, 5.119, 0.065, 0.0, 0.0, 1, "list"),
    (109, 5.156, 0.03, 1.0, 0.45, 0, "prose"),
    (240, 4.829, 0.021, 1.0, 0.425, 0, "prose"),
    (79, 5.38, 0.019, 1.0, 0.38, 0, "prose"),
    (83, 10.277, 0.001, 1.0, 0.0, 1, "gibberish"),
    (537, 4.659, 0.023, 1.0, 0.527, 0, "prose"),
    (90, 4.589, 0.499, 0.0, 0.0, 1, "spam"),
    (84, 5.321, 0.06, 0.0, 0.0, 1, "list"),
    (41, 26.805, 0.202, 0.0, 0.0, 1, "table"),
    (244, 4.885, 0.03, 1.0, 0.389, 0, "prose"),
    (90, 4.756, 0.016, 1.0, 0.422, 0, "prose"),
    (288, 4.74, 0.021, 1.0, 0.406, 0, "prose"),
    (137, 4.832, 0.023, 1.0, 0.526, 0, "prose"),
    (140, 4.857, 0.019, 1.0, 0.414, 0, "prose"),
    (264, 4.837, 0.02, 1.0, 0.413, 0, "prose"),
    (41, 5.561, 0.018, 1.0, 0.341, 0, "prose"),
    (71, 4.676, 0.015, 1.0, 0.394, 0, "prose"),
    (96, 5.594, 0.276, 0.0, 0.052, 1, "code"),
    (50, 4.74, 0.021, 1.0, 0.4, 0, "prose"),
    (247, 5.089, 0.018, 1.0, 0.397, 0, "prose"),
    (184, 4.978, 0.016, 1.0, 0.413, 0, "prose"),
    (120, 5.225, 0.024, 1.0, 0.367, 0, "prose"),
    (367, 4.58, 0.024, 1.0, 0.523, 0, "prose"),
    (161, 5.037, 0.022, 1.0, 0.379, 0, "prose"),
    (29, 4.621, 0.425, 0.0, 0.0, 1, "spam"),
    (240, 4.838, 0.018, 1.0, 0.446, 0, "prose"),
    (283, 4.403, 0.025, 1.0, 0.548, 0, "prose"),
    (1, 1004.0, 0.039, 0.0, 0.0, 1, "encoded"),
    (246, 4.703, 0.023, 1.0, 0.419, 0, "prose"),
    (160, 6.869, 0.089, 0.067, 0.362, 0, "mixed"),
    (256, 4.516, 0.022, 1.0, 0.551, 0, "prose"),
    (208, 4.74, 0.022, 0.25, 0.389, 0, "mixed"),
    (512, 5.104, 0.018, 1.0, 0.391, 0, "prose"),
    (193, 4.938, 0.025, 1.0, 0.389, 0, "prose"),
    (331, 4.918, 0.02, 1.0, 0.411, 0, "prose"),
    (431, 4.613, 0.019, 1.0, 0.436, 0, "prose"),
    (164, 4.476, 0.025, 0.118, 0.561, 0, "prose"),
    (62, 5.048, 0.016, 1.0, 0.5, 0, "prose"),
    (233, 5.009, 0.018, 1.0, 0.391, 0, "prose"),
    (87, 5.08, 0.02, 1.0, 0.414, 0, "prose"),
    (231, 4.81, 0.025, 0.5, 0.377, 0, "prose"),
    (313, 4.54, 0.021, 1.0, 0.527, 0, "prose"),
    (394, 4.756, 0.023, 1.0, 0.416, 0, "prose"),
    (135, 4.785, 0.017, 1.0, 0.415, 0, "prose"),
    (289, 4.457, 0.025, 1.0, 0.55, 0, "prose"),
    (177, 4.972, 0.013, 1.0, 0.424, 0, "prose"),
    (115, 4.887, 0.028, 0.077, 0.296, 0, "mixed"),
    (298, 5.013, 0.017, 1.0, 0.372, 0, "prose"),
    (1129, 4.759, 0.02, 1.0, 0.419, 0, "prose"),
    (285, 5.077, 0.019, 1.0, 0.425, 0, "prose"),
    (173, 4.803, 0.023, 1.0, 0.434, 0, "prose"),
    (104, 5.212, 0.03, 1.0, 0.413, 0, "prose"),
    (184, 4.19, 0.023, 0.1, 0.31, 0, "mixed"),
    (1, 664.0, 0.035, 0.0, 0.0, 1, "encoded"),
    (79, 4.342, 0.283, 0.0, 0.025, 1, "code"),
    (49, 3.714, 0.132, 0.0, 0.0, 1, "menu"),
    (156, 4.981, 0.018, 1.0, 0.41, 0, "prose"),
    (155, 5.129, 0.028, 1.0, 0.426, 0, "prose"),
    (22, 4.545, 0.02, 1.0, 0.591, 0, "prose"),
    (281, 4.9, 0.019, 1.0, 0.384, 0, "prose"),
    (135, 5.074, 0.019, 1.0, 0.37, 0, "prose"),
    (207, 4.86, 0.018, 1.0, 0.435, 0, "prose"),
    (85, 5.012, 0.023, 1.0, 0.388, 0, "prose"),
    (194, 4.737, 0.021, 1.0, 0.423, 0, "prose"),
    (201, 5.025, 0.019, 1.0, 0.443, 0, "prose"),
    (496, 4.831, 0.02, 1.0, 0.421, 0, "prose"),
    (132, 4.909, 0.019, 1.0, 0.417, 0, "prose"),
    (163, 4.969, 0.015, 1.0, 0.399, 0, "prose"),
    (189, 4.534, 0.023, 1.0, 0.519, 0, "prose"),
    (167, 3.186, 0.28, 0.0, 0.0, 1, "table"),
    (77, 4.909, 0.466, 0.0, 0.0, 1, "spam"),
    (114, 5.07, 0.029, 1.0, 0.342, 0, "prose"),
    (208, 5.159, 0.03, 1.0, 0.51, 0, "prose"),
    (371, 5.35, 0.03, 1.0, 0.447, 0, "prose"),
    (278, 4.734, 0.03, 1.0, 0.381, 0, "prose"),
    (137, 5.234, 0.029, 1.0, 0.46, 0, "prose"),
    (131, 5.107, 0.019, 1.0, 0.351, 0, "prose"),
    (64, 4.906, 0.494, 0.0, 0.0, 1, "spam"),
    (44, 4.727, 0.029, 1.0, 0.432, 0, "prose"),
    (119, 4.319, 0.037, 1.0, 0.538, 0, "prose"),
    (26, 5.154, 0.015, 1.0, 0.385, 0, "prose"),
    (581, 4.95, 0.02, 1.0, 0.396, 0, "prose"),
    (163, 5.049, 0.029, 1.0, 0.368, 0, "prose"),
    (137, 4.774, 0.024, 1.0, 0.547, 0, "prose"),
    (164, 5.238, 0.016, 1.0, 0.323, 0, "prose"),
    (258, 4.806, 0.019, 1.0, 0.411, 0, "prose"),
    (62, 4.774, 0.024, 1.0, 0.468, 0, "prose"),
    (193, 4.777, 0.022, 1.0, 0.383, 0, "prose"),
    (359, 4.794, 0.021, 1.0, 0.443, 0, "prose"),
    (208, 5.087, 0.017, 1.0, 0.385, 0, "prose"),
    (178, 4.792, 0.016, 1.0, 0.427, 0, "prose"),
    (158, 5.013, 0.016, 1.0, 0.399, 0, "prose"),
    (186, 5.108, 0.018, 1.0, 0.371, 0, "prose"),
    (80, 4.875, 0.028, 1.0, 0.425, 0, "prose"),
    (49, 3.571, 0.137, 0.0, 0.0, 1, "menu"),
    (72, 5.056, 0.066, 0.0, 0.0, 1, "list"),
    (69, 5.072, 0.066, 0.0, 0.0, 1, "list"),
    (411, 5.034, 0.019, 1.0, 0.404, 0, "prose"),
    (168, 4.935, 0.018, 1.0, 0.429, 0, "prose"),
    (180, 4.694, 0.021, 1.0, 0.433, 0, "prose"),
    (504, 4.859, 0.02, 1.0, 0.442, 0, "prose"),
    (1, 920.0, 0.042, 0.0, 0.0, 1, "encoded"),
    (264, 4.008, 0.147, 0.043, 0.163, 1, "table after a paragraph"),
    (190, 5.016, 0.02, 1.0, 0.416, 0, "prose"),
    (1, 704.0, 0.034, 0.0, 0.0, 1, "encoded"),
    (27, 22.333, 0.199, 0.0, 0.0, 1, "table"),
    (174, 4.707, 0.032, 1.0, 0.546, 0, "prose"),
    (153, 4.758, 0.018, 1.0, 0.412, 0, "prose"),
    (39, 4.949, 0.021, 1.0, 0.41, 0, "prose"),
    (217, 4.848, 0.029, 1.0, 0.502, 0, "prose"),
    (206, 4.505, 0.019, 1.0, 0.544, 0, "prose"),
    (92, 5.533, 0.029, 1.0, 0.489, 0, "prose"),
    (62, 5.129, 0.022, 1.0, 0.371, 0, "prose"),
    (153, 5.438, 0.029, 1.0, 0.51, 0, "prose"),
    (257, 4.833, 0.019, 1.0, 0.377, 0, "prose"),
    (321, 4.984, 0.016, 1.0, 0.389, 0, "prose"),
    (37, 10.541, 0.003, 1.0, 0.0, 1, "gibberish"),
    (120, 5.1, 0.033, 1.0, 0.417, 0, "prose"),
    (245, 4.82, 0.019, 1.0, 0.412, 0, "prose"),
    (119, 5.227, 0.031, 1.0, 0.429, 0, "prose"),
    (89, 4.787, 0.021, 1.0, 0.427, 0, "prose"),
    (112, 4.08, 0.048, 1.0, 0.509, 0, "prose"),
    (480, 4.99, 0.021, 1.0, 0.379, 0, "prose"),
    (19, 5.421, 0.029, 1.0, 0.368, 0, "prose"),
    (217, 4.857, 0.02, 0.091, 0.438, 0, "prose"),
    (321, 5.128, 0.03, 1.0, 0.505, 0, "prose"),
    (196, 4.857, 0.022, 1.0, 0.408, 0, "prose"),
]
