"""Constants of ``spam.curve_score``, fitted by ``spam.fit_prose`` and ``spam.fit_weights`` on ``spam.training_rows`` of the documents at sf0.1 (9,970 pages)."""

#: Shares of each frequency class (once, 2-3, 4-7, ...) in prose: (a, b, c) of a + b * ln n + c * (ln n)^2.
PROSE = {'w': {'latn': [(1.06132, -0.00074, -0.01445),
                (-0.18449, 0.09887, -0.00503),
                (-0.05362, 0.01495, 0.0021),
                (-0.03781, 0.0031, 0.00235),
                (0.04223, -0.03058, 0.0049),
                (0.08109, -0.04197, 0.00516),
                (0.05489, -0.02647, 0.00304),
                (0.02081, -0.00989, 0.00112),
                (0.01557, -0.00727, 0.00081)],
       'deva': [(0.73145, 0.20024, -0.04429),
                (0.09321, -0.0589, 0.0175),
                (0.02169, -0.03378, 0.00948),
                (0.06294, -0.0503, 0.00896),
                (0.09071, -0.05726, 0.00834),
                (0.0, -0.0, 0.0),
                (0.0, -0.0, 0.0),
                (0.0, -0.0, 0.0),
                (0.0, -0.0, 0.0)]},
 'b': {'latn': [(0.745, 0.14913, -0.0228),
                (0.11443, -0.07191, 0.01239),
                (0.08425, -0.04685, 0.00649),
                (0.02292, -0.01425, 0.00207),
                (0.0168, -0.00833, 0.00098),
                (0.01396, -0.00656, 0.00073),
                (0.00263, -0.00123, 0.00014),
                (0.0, -0.0, 0.0),
                (0.0, -0.0, 0.0)],
       'deva': [(0.55586, 0.28953, -0.04387),
                (0.42034, -0.27432, 0.04162),
                (0.02109, -0.01351, 0.002),
                (0.00271, -0.0017, 0.00025),
                (0.0, -0.0, 0.0),
                (0.0, -0.0, 0.0),
                (0.0, -0.0, 0.0),
                (0.0, -0.0, 0.0),
                (0.0, -0.0, 0.0)]}}

#: Log odds of each feature: (a, b) of a + b * ln n.
WEIGHTS = {'w_slope': (-2.8426, -0.0248),
 'w_residual': (1.5615, -0.8617),
 'w_divergence': (1.0206, 0.1796),
 'w_types': (-1.924, -0.2526),
 'w_top': (-25.0123, -3.9671),
 'w_c0': (-0.8882, 0.123),
 'w_c1': (5.2672, 0.2804),
 'w_c2': (4.5446, -1.0922),
 'w_c3': (-2.138, -1.0502),
 'w_c4': (-3.1841, -0.8716),
 'w_c5': (0.0013, -0.0139),
 'w_c6': (-0.5472, -0.1159),
 'w_c7': (-13.5534, -1.7361),
 'w_c8': (-21.1863, -2.5002),
 'b_slope': (-4.7094, -0.3573),
 'b_residual': (9.2581, 0.1948),
 'b_divergence': (1.9508, 0.3127),
 'b_types': (-5.1245, -0.5565),
 'b_top': (13.1224, 7.6585),
 'b_c0': (-3.3177, -0.3422),
 'b_c1': (5.6742, -0.3198),
 'b_c2': (10.3072, 0.099),
 'b_c3': (3.0208, 0.0659),
 'b_c4': (4.4313, 0.7063),
 'b_c5': (0.2125, 0.0232),
 'b_c6': (-0.1399, -0.0311),
 'b_c7': (0.0, 0.0),
 'b_c8': (0.0, 0.0),
 'm_0': (-22.0854, -5.3058),
 'm_1': (-13.0999, -6.0507),
 'm_2': (23.0343, 4.5026),
 'm_3': (35.4943, 2.5422),
 'm_4': (-6.3568, -1.7548),
 'm_5': (-19.3608, -1.5832),
 'm_6': (-11.7128, -2.1141)}

#: (constant, times ln n, times (ln n)^2, Devanagari)
INTERCEPT = (9.7669, -0.3824, -0.0774, -3.7032)
