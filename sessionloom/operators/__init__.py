"""sessionloom.operators"""
