"""Golden case: the 57 logged metric records of the published comparison run
(reward_type, step, loss, accuracy, perplexity) and its published summary."""

# --- Fixed values that must equal the reference's (published run) ---
ROWS = [
    ('hard', 100, 0.0, 0.1, 3.095640766620636),
    ('hard', 200, 0.0, 0.05, 2.6967565178871156),
    ('hard', 300, 0.0, 0.15, 2.702589583396912),
    ('hard', 400, 0.0, 0.1, 2.772956037521362),
    ('hard', 500, 0.0, 0.05, 2.7582719564437865),
    ('hard', 600, 0.0, 0.15, 2.723646581172943),
    ('hard', 700, 0.0, 0.0, 2.7234416723251345),
    ('hard', 800, 0.0, 0.15, 2.638912284374237),
    ('hard', 900, 0.0, 0.1, 2.570402616262436),
    ('hard', 1000, 0.0, 0.05, 2.620454120635986),
    ('hard', 1100, 0.0, 0.2, 2.975045943260193),
    ('hard', 1200, 0.0, 0.2, 2.9628554463386534),
    ('hard', 1300, 0.0, 0.25, 2.6630718648433684),
    ('hard', 1400, 0.0, 0.15, 2.6556434631347656),
    ('hard', 1500, 0.0, 0.05, 2.6045425832271576),
    ('hard', 1600, 0.0, 0.2, 2.60629745721817),
    ('hard', 1700, 0.0, 0.1, 2.6005532503128053),
    ('hard', 1800, 0.0, 0.1, 2.5863504827022554),
    ('hard', 1900, 0.0, 0.3, 2.6534804880619047),
    ('hard', 2000, 0.0, 0.1, 2.611873209476471),
    ('hard', 2100, 0.0, 0.05, 2.8088031649589538),
    ('hard', 2200, 0.0, 0.2, 2.6419832944869994),
    ('hard', 2300, 0.0, 0.2, 2.63865122795105),
    ('hard', 2400, 0.0, 0.1, 2.5687121868133547),
    ('hard', 2500, 0.0, 0.15, 2.6396114408969877),
    ('hard', 2600, 0.0, 0.0, 2.626336061954498),
    ('hard', 2700, 0.0, 0.35, 2.5769657671451567),
    ('hard', 2800, 0.0, 0.25, 2.5394344568252563),
    ('hard', 2900, 0.0, 0.1, 2.5585007429122926),
    ('hard', 3000, 0.0, 0.15, 2.585418438911438),
    ('hard', 3100, 0.0, 0.1, 2.5343838691711427),
    ('hard', 3200, 0.0, 0.15, 2.5868229269981384),
    ('hard', 3300, 0.0, 0.2, 2.561128258705139),
    ('hard', 3400, 0.0, 0.15, 2.5712243139743807),
    ('hard', 3500, 0.0, 0.1, 2.5413670361042024),
    ('hard', 3600, 0.0, 0.2, 2.6217365682125093),
    ('hard', 3700, 0.0, 0.1, 2.5923214077949526),
    ('hard', 3750, 0.8801908213297526, 0.25, 2.5362130224704744),
    ('perplexity', 100, 0.0, 0.1, 2.7500955700874328),
    ('perplexity', 200, 0.0, 0.05, 2.6202985048294067),
    ('perplexity', 300, 0.0, 0.1, 2.810670530796051),
    ('perplexity', 400, 0.0, 0.05, 2.7592135787010195),
    ('perplexity', 500, 0.0, 0.05, 3.3764472007751465),
    ('perplexity', 600, 0.0, 0.15, 3.896474766731262),
    ('perplexity', 700, 0.0, 0.2, 2.6602328777313233),
    ('perplexity', 800, 0.0, 0.2, 2.6306405782699587),
    ('perplexity', 900, 0.0, 0.05, 2.707885193824768),
    ('perplexity', 1000, 0.0, 0.15, 2.6289128005504607),
    ('perplexity', 1100, 0.0, 0.2, 3.012266236543655),
    ('perplexity', 1200, 0.0, 0.1, 2.8013490557670595),
    ('perplexity', 1300, 0.0, 0.1, 3.025540018081665),
    ('perplexity', 1400, 0.0, 0.15, 2.766689968109131),
    ('perplexity', 1500, 0.0, 0.1, 2.632616567611694),
    ('perplexity', 1600, 0.0, 0.2, 2.6000640749931336),
    ('perplexity', 1700, 0.0, 0.15, 2.5895516753196715),
    ('perplexity', 1800, 0.0, 0.15, 2.610781562328339),
    ('perplexity', 1875, 0.9004515563964843, 0.25, 2.697066271305084),
]
SUMMARY = {'final_accuracy_hard': 0.25, 'final_accuracy_perplexity': 0.25, 'best_accuracy_hard': 0.35, 'best_accuracy_perplexity': 0.25, 'improvement': 0.0}
RECOMMENDATION = 'Use hard reward: achieved best accuracy of 0.350. Hard rewards converge faster to verifiable answers.'
# --- end of fixed values ---
